"""The pipeline against brute force, stage by stage, and the SQL of the queries that have one."""

import math
import zlib
from collections import Counter

import corpus_pipeline as C
import numpy as np
import pytest

from slatework.llm import mixing, queries, sharding, simhash
from tools.check_oracle import _rows, duck_connect

from ..conftest import SMALL
from .data import AWKWARD, table
from .test_decontam import shingles
from .test_shares import naive_shards


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def naive_groups(texts):
    """{id: smallest id reachable over fingerprints at most two bits apart}."""
    names = sorted(texts)
    fps = np.array([simhash.fingerprint((texts[i] or "").encode()) for i in names], np.uint64)
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(names)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {names[i]: names[find(i)] for i in range(len(names))}


def test_stages_equal_brute_force(spark):
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination",
                                        "mixing to target weights", "sharding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = {}
    cur = docs
    for name, stage in C.STAGES:
        cur = C.stored(stage(spark, cur, SMALL), "stage")
        steps[name] = cur
        if name != "sharding":
            assert cur.columns == docs.columns
    assert cur.columns == [*docs.columns, "shard", "slot"]

    clean = steps["toxicity"]
    assert clean.exceptAll(docs).count() == 0
    bad = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1").collect()}
    gone = set(ids(docs)) - set(ids(clean))
    assert len(gone & bad) >= len(gone) // 3 and len(gone) < 0.2 * docs.count()

    texts = {r.doc_id: r.text for r in clean.collect()}
    groups = naive_groups(texts)
    assert ids(steps["simhash near-dedup"]) == sorted(set(groups.values()))

    items = [shingles(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = [i for i in sorted(set(groups.values())) if not any(5 * len(s & shingles(texts[i])) >= 4 * len(s) for s in items if s)]
    assert ids(steps["benchmark decontamination"]) == kept

    duck = duck_connect(SMALL)
    duck.register("stage_input", steps["benchmark decontamination"].toPandas())
    sql = mixing.SQL.replace("FROM documents", "FROM stage_input")
    copies = {r[0]: math.floor(r[4] / r[1] + 0.5) for r in duck.execute(sql).fetchall() if r[1]}
    mixed = Counter(ids(steps["mixing to target weights"]))
    assert mixed == {i: n for i, n in copies.items() if n}

    line = steps["sharding"].select("doc_id", "shard", "slot", "text", "source").collect()
    assert Counter(r.doc_id for r in line) == mixed
    rows = sorted(((r.doc_id, r.text, None, r.source, 1) for r in line), key=lambda r: zlib.crc32(r[1].encode()))
    want = naive_shards(rows, sharding.SHARDS, sharding.SEED, each=True)
    assert sorted((r.doc_id, r.shard, r.slot) for r in line) == want


def test_run_writes_and_rereads_each_stage(spark, monkeypatch):
    seen = []

    def stage(n):
        def f(s, docs, sf_dir):
            seen.append((n, docs.count(), sf_dir))
            return docs.filter(f"doc_id % {n} = 0")
        return f
    monkeypatch.setattr(C, "STAGES", [("two", stage(2)), ("five", stage(5))])
    assert ids(C.run(spark, SMALL)) == [i for i in range(200) if i % 10 == 0]
    assert seen == [(2, 200, SMALL), (5, 100, SMALL)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    res = duck_connect(SMALL).execute(queries.ORACLE[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in res.description], res.fetchall())


def pipeline_inputs(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_stages_take_awkward_rows_and_clashing_columns(spark, tmp_path):
    docs = table(spark, AWKWARD, clash=True)
    sf = pipeline_inputs(spark, tmp_path, docs)
    out = C.run(spark, sf)
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    assert out.columns == [*kept, "shard", "slot"]
    rows = out.collect()
    words = {r[1] for r in AWKWARD if r[1] and r[1].split()}
    assert {r.text for r in rows} <= words  # texts without words give nothing to the mix
    assert len({r.text for r in rows}) >= 3
    assert all(r["a.b"] == "dot" and (r._ka, r._kb, r._text, r._id) == (1, 2, "no", 3) and r.notes == {"k": r.doc_id} for r in rows)


def test_empty_tables_pass_every_stage(spark, tmp_path):
    docs = table(spark, AWKWARD, clash=True).limit(0)
    sf = pipeline_inputs(spark, tmp_path, docs)
    for _, stage in C.STAGES:
        assert stage(spark, docs, sf).count() == 0
    assert C.run(spark, sf).count() == 0
