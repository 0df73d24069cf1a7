import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slatework.llm import simhash as S
from slatework.llm.components import components

from .data import AWKWARD, table


def unsigned(x):
    return int(np.int64(x).astype(np.uint64))


def naive(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_equals_definition(spark):
    for t in ("", None, "One", "one two", "A b c D\x0bé É " * 7, "a b c d a b c d", "İ Σ x"):
        assert S.fingerprint(t.encode() if t else None) == naive(t)
    assert spark.range(1).select(F.xxhash64(F.lit("a é"))).first()[0] == np.uint64(S._xxh("a é".encode())).astype(np.int64)


def test_golay_code_is_perfect_and_near_indices_meet():
    e = S._errors()
    assert (S._syndrome(e.ravel()) == np.repeat(np.arange(2048), 6)).all()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    near = S.near_indices(words)
    for bit in range(23):  # one bit apart: the home index is among the other's near ones
        assert (S.near_indices(words ^ (1 << bit)) == near[:, :1]).any(axis=1).all()


@pytest.mark.parametrize("bucket", [0, 2, 1000])
def test_links_connect_what_two_bits_connect(spark, bucket):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rnd.randint(1, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    arr = np.array(fps, np.uint64)
    for i, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2):
            parent[find(fps[j])] = find(x)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    got = {unsigned(r.node): unsigned(r.root) for r in components(S.links(df, bucket)).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(find(x), set()).add(x)
    for g in groups.values():
        assert len({got.get(x, x) for x in g}) == 1
    assert len({got.get(x, x) for x in fps}) == len(groups)


def test_long_chain_and_empty(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r.root for r in components(e).collect()} == {0}
    assert components(e.limit(0)).count() == 0


def test_awkward_rows(spark):
    got = S.near_duplicates(table(spark, AWKWARD, clash=True)).collect()
    assert len(got) == len(AWKWARD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[5] == {5} and by[1] == by[2] == by[3] == {1} and by[6] == {6} and by[9] == {5, 6} and by[None] == {5, 1}
    assert S.near_duplicates(table(spark, [])).count() == 0


def test_stage_keeps_one_row_of_each_group(spark):
    docs = table(spark, AWKWARD, clash=True)
    got = S.stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in got.collect()) == [
        (1, ""), (4, "wor"), (5, "The"), (6, "Ent"), (7, "x"), (8, "$$$")]
    only_null = table(spark, [(None, "a b c", None, None, None)] * 2)
    assert S.stage(spark, only_null, "").count() == 1
    assert S.stage(spark, docs.limit(0), "").count() == 0
