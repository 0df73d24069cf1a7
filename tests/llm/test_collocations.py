import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from slatework.llm import collocations as C
from slatework.llm.hat_trie import BITS, HatTrie

from .data import AWKWARD, rows, table

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, least, top):
    """By the definition."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        inside = any(o[0] == lang and len(o[1]) > len(p) and 100 * b >= 80 * a
                     and any(o[1][i:i + len(p)] == p for i in range(len(o[1]) - len(p) + 1)) for o, b in cand.items())
        if not inside:
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items()
                   for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])), key=repr)


def corpus(seed, n, vocabulary):
    rnd = random.Random(seed)
    seps = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "! ", " : "]
    words = [rnd.choice(["New", "York", "é", "Çity", "😀", "the", "of"]) for _ in range(3)] + [f"W{i}" for i in range(vocabulary)]
    def text():
        return "".join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))])[0] + rnd.choice(seps) for _ in range(rnd.randint(0, 60)))
    return [(rnd.choice(["en", "en", "de", None, "und"]), text()) for _ in range(n)]


@pytest.mark.parametrize("bounds", [{}, {"limit": 50, "words": 10, "burst": 3}])
@pytest.mark.parametrize("least", [1, 4])
def test_against_brute_force(spark, bounds, least):
    docs = corpus(least, 60, 12)
    df = table(spark, [(i, t, lang, "s", 1) for i, (lang, t) in enumerate(docs)], clash=True).withColumns({"phrase": F.lit(1), "a.b": F.lit(2)})
    assert rows(C.collocations(df, least=least, top=40, **bounds)) == brute(docs, least, 40)


def test_awkward_rows_and_empty_table(spark):
    docs = table(spark, AWKWARD, clash=True)
    got = C.collocations(docs, least=2)
    assert rows(got) == brute([(r[2], r[1]) for r in AWKWARD], 2, 2000)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"),
                          ("n", "bigint"), ("score", "bigint")]
    assert C.collocations(docs.limit(0)).count() == 0


def test_a_long_text_in_steps(spark, monkeypatch):
    rnd = random.Random(2)
    text = " ".join(rnd.choices(["a", "b", "c", "d."], k=5000))
    monkeypatch.setattr(C, "STEP", 7)
    counter = C._Counter((3, 4), np.full(1 << (C.FILTER_BITS - 3), 255, np.uint8), 100, 3, 5)
    found = Counter()
    for batch in [*counter.add("en", [text, text]), *counter.runs(end=True)]:
        for p, n in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            found[p] += n
    want = Counter()
    for piece in text.split("."):
        ws = piece.split()
        want.update(" ".join(ws[i:i + k]) for k in (3, 4) for i in range(len(ws) - k + 1))
    assert found == Counter({p: 2 * n for p, n in want.items()})


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**12
    x = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long").select(F.expr(C.SCORE).alias("score"))
    assert x.first().score == 2000000 * big // (2 * big + 3)


def test_trie_counts_bursts_and_spills_the_largest():
    rnd = random.Random(1)
    trie, want = HatTrie(burst=4), Counter()
    for _ in range(400):
        first = rnd.randint(1, 5) if rnd.random() < 0.5 else 1
        rests = sorted({(rnd.randint(1, 4) << 2 * BITS) | (rnd.randint(0, 5) << BITS) for _ in range(3)})
        trie.add(first, rests, [1] * len(rests))
        want.update((first, r) for r in rests)
    assert type(trie.root[1]) is not dict and trie.entries == len(want) == sum(trie.sizes.values())
    found = Counter()
    for first, rest, n in trie.spill(trie.entries // 2):
        found.update({(first, r): c for r, c in zip(rest.tolist(), n.tolist())})
    assert 1 not in trie.root and 0 < trie.entries <= len(want) // 2
    for first, rest, n in trie.spill(0):
        found.update({(first, r): c for r, c in zip(rest.tolist(), n.tolist())})
    assert found == want and not trie.entries


def test_runs_are_sorted():
    counter = C._Counter((2,), np.full(1 << (C.FILTER_BITS - 3), 255, np.uint8), 10**6, 10**6, 4)
    list(counter.add("en", ["b a c a b c a. c c b"]))
    (run,) = counter.runs(end=True)
    phrases = run.column(1).to_pylist()
    assert phrases == sorted(phrases) and "a c" in phrases and "a. c" not in phrases


def test_query_and_sql(spark, tmp_path):
    docs = corpus(9, 900, 6)
    table(spark, [(i, t, lang, "s", 1) for i, (lang, t) in enumerate(docs)], clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = rows(C.query(spark, str(tmp_path)))
    assert got and got == sorted(db.execute(C.SQL).fetchall(), key=repr)


def test_pair_hashes_are_merged(monkeypatch):
    monkeypatch.setattr(C, "SLOT_ROWS", 3)
    monkeypatch.setattr(C, "STEP", 4)
    counter = C._Counter((1,), None, 10**6, 10**6, 4)
    found = Counter()
    for batch in [*counter.add("en", ["a b c. a b c a b. b a", "a b c"]), *counter.runs(end=True)]:
        for slot, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if slot is not None:
                found[slot] += n
    assert sorted(found.values()) == [1, 1, 3, 4]  # c a, b a, b c, a b
