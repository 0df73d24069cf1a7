import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from slatework.llm import merkle as M

from .data import AWKWARD, table


def naive(text):
    leaves = [m[0] for m in re.finditer(M.LEAF, text)]
    assert "".join(leaves) == text
    d = "".join(hashlib.md5(x.encode()).hexdigest()[:M.DIGEST] + "," for x in leaves)
    parts = re.sub(rf"\b(0[0-9a-f]{{{M.DIGEST - 1}}},)", r"\1|", d).split("|")
    root = hashlib.sha256("".join(hashlib.md5(p.encode()).hexdigest() for p in parts).encode()).hexdigest()[:32]
    return f"{root}:{d}"


@pytest.mark.parametrize("per", [3, 1000])
def test_fingerprints_and_neighbours(spark, per):
    rnd = random.Random(7)
    texts = {i * i - 50: "".join(rnd.choices("ab é😀.!?\n ", k=rnd.randint(0, 400))) for i in range(120)}
    got = {r._id: r for r in M.with_next(table(spark, [(d, t, "en", "s", 1) for d, t in texts.items()]), "doc_id", "text", per).collect()}
    ids = sorted(texts, reverse=True)
    for i, d in enumerate(ids):
        nxt = texts[ids[(i + 1) % len(ids)]]
        assert (got[d]._text, got[d]._next_text) == (texts[d], nxt)
        assert (got[d]._fp, got[d]._next_fp) == (naive(texts[d]), naive(nxt))


def test_edit_is_found_and_likeness_follows(spark):
    a = " ".join(f"Sentence number {i} of the text." for i in range(100))
    b = a.replace("number 40 of", "number forty of")
    c = " ".join(f"Quite other words {i} are here." for i in range(100))
    df = spark.createDataFrame([(a, b, c)], "a string, b string, c string").select(*[M.fingerprint(F.col(x)).alias(x) for x in "abc"])
    r = df.select(M.likeness(F.col("a"), F.col("b")).alias("ab"), M.likeness(F.col("a"), F.col("c")).alias("ac"),
                  M.likeness(F.col("a"), F.col("a")).alias("aa"), F.size(M.differing_leaves(F.col("a"), F.col("b"))).alias("n")).first()
    assert r.aa == 1 and r.ab > 0.95 and r.ac == 0 and r.n == 1


@pytest.mark.parametrize("seed", range(3))
def test_ends_are_those_of_the_leaves(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(150):
        a = rnd.choices(["a.", "b.", "c.", "dd.", "e!", "f?", "16.", "3."], k=rnd.randint(0, 40))
        i, j = sorted(rnd.choices(range(len(a) + 1), k=2))
        b = rnd.choice([a, a[:i] + rnd.choices(["a.", "zz.", "16."], k=rnd.randint(0, 3)) + a[j:], a[i:], a[:j]])
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("*", M.same_ends(M.fingerprint(F.col("a")), M.fingerprint(F.col("b"))).alias("e")).collect()
    for r in got:
        x, y = (re.findall(M.LEAF, t) for t in (r.a, r.b))
        head = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        rest = min(len(x), len(y)) - head
        tail = next((k for k in range(rest) if x[-1 - k] != y[-1 - k]), rest)
        assert (r.e.head, r.e.tail) == (head, tail), (r.a, r.b)


def test_edited_text(spark):
    rows = [("abcde", "XYZ", "abcXY"), ("ab😀d", "é", "abé"), ("", "x", ""), ("a", "b", "a"), ("abcdef", "", "abc")]
    df = spark.createDataFrame(rows, "t string, n string, want string")
    assert all(r[0] == r[1] for r in df.select(M.edited(F.col("t"), F.col("n")), "want").collect())


@pytest.mark.parametrize("per", [2, 100])
def test_awkward(spark, per):
    docs = table(spark, AWKWARD, clash=True)
    got = M.with_next(docs, "doc_id", "text", per).collect()
    assert len(got) == len(AWKWARD)
    by = {}
    for r in got:
        assert by.setdefault(r._text, r._fp) == r._fp  # equal texts, equal fingerprints
    assert {r._text for r in got if r._id in (2, 1)} == {""}
    nine = {r._text: r._next_text for r in got if r._id == 9}
    assert any(t.startswith("$$$") for t in nine.values())  # the next after both rows of 9 is 8
    assert {r._next_text for r in got if r._id == 1} <= {"", AWKWARD[0][1]}  # null ids follow
    one = M.with_next(table(spark, [(1, "abc", "en", "s", 3)]), "doc_id", "text").collect()
    assert (one[0]._next_text, one[0]._next_fp) == ("abc", one[0]._fp)
    assert M.with_next(docs.limit(0), "doc_id", "text").count() == 0


def test_colliding_short_texts_differ(spark, tmp_path):
    a, b = "Record 6426 closed.", "Record 6728 closed."  # md5 of both begins with 081f59
    df = spark.createDataFrame([(a, b)], "a string, b string")
    full = df.select(*[M.fingerprint(F.col(x)).alias(x) for x in "ab"])
    assert full.select(M.likeness(F.col("a"), F.col("b"))).first()[0] == 0
    r = full.first()
    assert r.a[:32] != r.b[:32]
    docs = [(1, a, "en", "s", 1), (2, b, "en", "s", 1), (3, b, "en", "s", 1)]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.near_next for r in M.query(spark, str(tmp_path)).collect()}
    assert got == {3: 1, 2: 0, 1: 0}


def test_moved_leaves_are_found(spark):
    parts = [f"Sentence number {i} of the text. " for i in range(60)]
    moved = [*parts[:20], parts[21], parts[20], *parts[22:]]
    two = ["Changed. " if i in (5, 50) else x for i, x in enumerate(parts)]
    df = spark.createDataFrame([("".join(parts), "".join(moved), "".join(two))], "a string, b string, c string")
    full = df.select(*[M.fingerprint(F.col(x)).alias(x) for x in "abc"])
    r = full.select(*[M.differing_leaves(F.col("a"), F.col(x)).alias(x) for x in "abc"]).first()
    md5 = [hashlib.md5(x.encode()).hexdigest() for x in parts]
    assert r.a == [] and r.b == md5[20:22] and {md5[5], md5[50]} <= set(r.c)


def test_query_equals_its_sql_at_two_sizes(spark):
    import duckdb
    for sf in ("0.001", "0.01"):
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf{sf}/documents.parquet'")
        want = {r[0]: r for r in db.execute(M.SQL).fetchall()}
        out = M.query(spark, f"/root/testdata/sf{sf}")
        assert out.columns == [c[0] for c in db.description]
        got = {r.doc_id: tuple(r) for r in out.collect()}
        assert got == want


def test_many_null_ids_are_dealt_over_buckets(spark):
    docs = table(spark, [(None if i % 3 else i, f"text {i}", "en", "s", 1) for i in range(600)])
    got = M.with_next(docs, "doc_id", "text", 20).collect()
    assert len(got) == 600
    # one ring through all rows
    after = {r._text: r._next_text for r in got}
    seen, at = set(), "text 0"
    while at not in seen:
        seen.add(at)
        at = after[at]
    assert len(seen) == 600
