import random
import re

from pyspark.sql import functions as F

from slatework.llm import pii as P

from .data import AWKWARD, table

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")),
            "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    out = [(m.start(), k, m.end()) for k, kind in enumerate(P.KINDS) for m in re.finditer(PATTERNS[kind], text or "") if valid(kind, m[0])]
    return ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def listed(df):
    return [(r._id, r.b, r.s) for r in P.extract(df).select("_id", P.listed(F.col("base")).alias("b"), P.listed(F.col("spans")).alias("s")).collect()]


def test_base_spans_equal_the_patterns(spark):
    rnd = random.Random(8)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "_", "a@b", "@c.d", "1.2.3.4", "255.255.255.255", "256.1.1.1", "00001.2.03.4.5.6.7.8",
            "4111111111111111", "4111 1111-1111 1111", "4111  1111", "1 2 3 4 5 6 7 8 9 0 1 2", "+1 (310) 555-4444", "+12", "+1 -", "+49.30.1234567-",
            "12345678901234567890123", " ", "\n", "é", "😀", "-", "%", "9", "0" * 15]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 30))) for _ in range(400)]
    got = listed(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    for i, b, s in got:
        assert b == base(texts[i]), texts[i]
        assert set(b.split(",")) <= set(s.split(",")) | {""}


def test_long_runs_neither_overflow_nor_stall(spark):
    texts = ["1 " * 60_000, "9" * 120_000, "a@" + "b." * 40_000 + "c", "x" * 120_000, "a.1-" * 30_000, "+1" + " (" * 50_000]
    for i, b, _ in listed(table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])):
        assert b == (f"email:0:{len(texts[2])}" if i == 2 else "")


def test_bootstrapping_finds_unseen_identifiers(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        n = "4" + "".join(rnd.choices("0123456789", k=14))
        n += next(c for c in "0123456789" if luhn(n + c))
        rows.append((i, f"Please charge my card number {n} for the order {i}a today.", "en", "s", 1))
    unseen = ["4929-XXXX-1234-99", "5500123412341230"]  # no base form: letters; fails Luhn
    assert not luhn(unseen[1])
    rows += [(100 + i, f"So charge my card number {u} for the flat 12345678 there.", "en", "s", 1) for i, u in enumerate(unseen)]
    rows += [(200 + i, f"The build {rnd.randint(10**7, 10**8)} went out in week {i}.", "en", "s", 1) for i in range(30)]
    got = {i: (b, s) for i, b, s in listed(table(spark, rows))}
    for i, u in enumerate(unseen):
        text = rows[60 + i][1]
        at = text.index(u)
        assert got[100 + i] == ("", f"card:{at}:{at + len(u)}")
    assert all(b == s for i, (b, s) in got.items() if not 100 <= i < 200)


def test_awkward(spark):
    docs = table(spark, [*AWKWARD, (None, "mail a@b.co now", None, None, None), (5, "mail a@b.co now", "en", "s", 1)], clash=True)
    got = listed(docs)
    assert len(got) == len(AWKWARD) + 2
    assert sorted(b for _, b, _ in got if b) == ["email:5:11"] * 2
    assert P.extract(docs.limit(0)).count() == 0


def test_bootstrapping_finds_grouped_and_digitless_identifiers(spark):
    rnd = random.Random(10)
    say = {"card": "Please charge my card number {} for the order.", "phone": "You may call me under {} in the evening.",
           "email": "Better write to me at {} for the details."}
    rows = []
    for i in range(60):
        n = "4" + "".join(rnd.choices("0123456789", k=14))
        n += next(c for c in "0123456789" if luhn(n + c))
        known = {"card": n, "phone": f"+49 30 {rnd.randint(10**6, 10**7 - 1)}", "email": f"name{i}@mail.example.com"}
        rows += [(3 * i + k, say[kind].format(known[kind]), "en", "s", 1) for k, kind in enumerate(say)]
    unseen = [("card", "4929 1234 1234 9999"), ("phone", "030 1234 567"), ("phone", "(310) 555-4444"), ("phone", "110"),
              ("email", "jane.doe@corp"), ("card", "4929-XXXX 12")]
    assert not luhn("4929123412349999")
    rows += [(1000 + i, say[kind].format(u), "en", "s", 1) for i, (kind, u) in enumerate(unseen)]
    rows += [(2000, "We met at 10 30 and left 4929 1234 1234 9998 boxes there.", "en", "s", 1)]
    got = {i: (b, s) for i, b, s in listed(table(spark, rows))}
    for i, (kind, u) in enumerate(unseen[:5]):
        at = say[kind].index("{")
        assert got[1000 + i] == ("", f"{kind}:{at}:{at + len(u)}"), u
    at = say["card"].index("{")
    assert got[1005][1].startswith(f"card:{at}:{at + 9}")
    assert got[2000] == ("", "")


def test_candidates():
    found = re.compile(P.CANDIDATE).findall
    assert found("030 1234 567, (310) 555-4444 12 4929-XXXX-1 a@b 7. x @ -- 1 2") == [
        "030 1234 567", "(310) 555-4444 12", "4929-XXXX-1", "a@b", "7.", "1 2"]


def test_contexts_are_read_in_whole_words(spark):
    """A neighbour word of any length is part of the pattern, not only its end."""
    tail, rows = "z" * 60, []
    for i in range(60):
        rows.append((i, f"{'a' * 30}{tail} card {4111111111111111 if i % 2 else 5500000000000004} " + "ok" * 40 + "b", "en", "s", 1))
    found = P.extract(table(spark, rows)).count()
    text = F.lit(f"{'a' * 30}{tail} 4111111111111111 {'ok' * 40}b next")
    m = spark.range(1).select(P.matches(text, P.PATTERNS["card"]).alias("m")).first().m[0]
    assert found == 60 and m["left"].strip() == "a" * 30 + tail and m["right"].strip() == "ok" * 40 + "b"
    m = spark.range(1).select(P.matches(F.lit("one two three 4111111111111111"), P.PATTERNS["card"]).alias("m")).first().m[0]
    assert m["left"].split() == ["two", "three"] and m["right"] == ""


def test_query_end_to_end(spark, tmp_path):
    import hashlib
    rnd = random.Random(12)
    bits = ["a@b.c", "1.2.3.4", "4111111111111111", "+49 30 1234567", "word", "12", "x@", "\n", "é"]
    rows = [(i, " ".join(rnd.choices(bits, k=rnd.randint(0, 12))), "en", "s", 1) for i in range(150)] + [(None, None, None, None, None), (900, "", "en", "s", 0)]
    table(spark, rows, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    out = P.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        want = base(text)
        kinds = [x.split(":")[0] for x in want.split(",")]
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [kinds.count(k) for k in P.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(got[i].spans.split(",")) | {""}
