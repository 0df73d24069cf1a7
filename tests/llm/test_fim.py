import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slatework.llm import fim

from .data import AWKWARD, rows, table

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """By the definition, on the whole text."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


texts = st.text(st.sampled_from(list("ab é😀\n\t\x0b\x1c <PSM>")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(1, 9), st.integers(0, 45), st.integers(0, 45))
def test_frames_find_units_and_stretches(text, size, u, v):
    frames, n, chars = fim._Packer(size).pack([text[:v], text[v:]])
    units = UNIT.findall(text)
    doc = fim.Framed(frames, n, chars)
    assert (n, chars) == (len(units), len(text))
    assert all(len(doc.text(k)) <= size for k in range(len(frames)))
    assert doc.place(u) == len("".join(units[:u]))
    a, b = sorted((u, v))
    assert "".join(doc.stream(min(a, chars), min(b, chars))) == text[a:b]
    assert "".join(doc.stream()) == text
    assert doc.signs() == {s: text.index(s) for s in fim.SIGNS if s in text}


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(1, 9), st.integers(-50, 50))
def test_round_trip(text, size, ident):
    pack = fim._Packer(size).pack
    frames, n, chars = pack([text])
    doc = fim.Framed(frames, n, chars)
    form, a, b = fim.plan(doc, any(s in text for s in fim.SIGNS), str(ident))
    n_want, form_want, pre, mid, out = plain(ident, text)
    assert (n, form) == (n_want, form_want)
    assert form == "plain" or (a, b - a) == (pre, mid)
    frames, _, chars = pack(fim.output(doc, form, a, b))
    made = fim.Framed(frames, 0, chars)
    assert "".join(made.stream()) == out
    assert "".join(fim.restored(made, form)) == text


@pytest.mark.parametrize("frame", [3, fim.FRAME])
def test_table_against_brute_force(spark, frame):
    given = [*AWKWARD, (77, "a <P> b", "en", "s", 1), (78, "x" * 200_000 + " y", "en", "s", 1), (79, " " * 70_000, "en", "s", 1)]
    given += [(i, "w é\n" * (i % 50), None, None, None) for i in range(100, 200)]
    if frame == 3:
        given = [r for r in given if len(r[1] or "") < 500]
    docs = table(spark, given, clash=True).withColumns({"a.b": F.lit(1), "frames": F.create_map(F.lit(1), F.lit(2)), "output": F.lit(3)})
    out = fim.transform(fim.frame_table(docs, frame=frame), frame=frame)
    want = [(i, *plain(i, t)) for i, t, *_ in given]
    got = fim.texts(out).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_text")
    assert rows(got) == sorted(want, key=repr)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    got = fim.digests(out).select("doc_id", "output_sha256", "restored_sha256")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert rows(got) == sorted([(i, sha(plain(i, t)[4]), sha(t)) for i, t, *_ in given], key=repr)
    assert fim.digests(fim.transform(fim.frame_table(docs.limit(0)))).count() == 0


def test_query_and_sql(spark, tmp_path):
    given = [*AWKWARD, *[(i, "w é\n z" * (i % 30), "en", "s", 1) for i in range(100, 200)]]
    table(spark, given, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    out = fim.query(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"),
                          ("output_sha256", "string"), ("restored_sha256", "string")]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(out) == sorted(db.execute(fim.SQL).fetchall(), key=repr)
