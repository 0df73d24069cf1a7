"""Fill-in-middle transformation over seekable compressed frames (operator 13).

``frame_table`` stores each text as independent zstandard frames of ``FRAME``
code points. A frame carries the number of units that end, and of code points
that lie, before it. The place after the u-th unit is found by a binary search
over these counts and by decompressing the one frame that holds it; a stretch of
text is streamed by decompressing the frames it touches, one at a time.

``transform`` draws the cuts from the id, finds their places in the frames and
writes the output as frames too. ``restored`` finds the signs in an output's
frames and streams prefix, middle and suffix in the text's order. ``digests``
hashes both as streams. A text is whole in memory only where Spark hands it over
as one value; from the frames on it is one frame at a time.

Units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+`` and a last run of blanks.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField,
                               StructType)

from .common import slices, stored, table

PREFIX, SUFFIX, MIDDLE = SIGNS = ("<P>", "<S>", "<M>")
FRAME = 1 << 16  # code points of a frame
SEED = 42

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = frozenset(" \t\n\x0b\x0c\r")
_SIGN = re.compile("<[PSM]>")

FRAMES = ArrayType(StructType([StructField("units", IntegerType()), StructField("chars", IntegerType()), StructField("data", BinaryType())]))
_ARROW = pa.list_(pa.struct([("units", pa.int32()), ("chars", pa.int32()), ("data", pa.binary())]))


class _Packer:
    """Cuts a stream of text into frames."""

    def __init__(self, size: int = FRAME) -> None:
        self.size, self.zip = size, zstandard.ZstdCompressor(level=3, write_checksum=True)

    def pack(self, pieces: Iterable[str]) -> tuple[list[dict], int, int]:
        """(frames, units, code points)."""
        frames: list[dict] = []
        units = chars = 0
        held, n, inside = [], 0, False  # inside: the last sign is not blank, its word not yet counted

        def close() -> None:
            nonlocal units, chars, held, n, inside
            text = "".join(held)
            if text:
                # a word ends where a blank follows: one that runs to the frame's end counts in a later frame
                ended = len(_WORD.findall(text)) + (inside and text[0] in _BLANK)
                still = text[-1] not in _BLANK
                frames.append({"units": units, "chars": chars, "data": self.zip.compress(text.encode(errors="surrogatepass"))})
                units, chars = units + ended - still, chars + len(text)
                inside = still
            held, n = [], 0

        for piece in pieces:
            at = 0
            while at < len(piece):
                part = piece[at:at + self.size - n]
                held.append(part)
                at, n = at + len(part), n + len(part)
                if n == self.size:
                    close()
        close()
        return frames, units + bool(chars), chars  # the last word, or the blanks behind it


class Framed:
    """A framed text, read frame by frame."""

    def __init__(self, frames: list[dict], n: int, n_chars: int) -> None:
        self.frames, self.n, self.n_chars = frames, n, n_chars
        self.unzip = zstandard.ZstdDecompressor()

    def text(self, k: int) -> str:
        return self.unzip.decompress(self.frames[k]["data"]).decode(errors="surrogatepass")

    def place(self, units: int) -> int:
        """Code points before the end of the given number of units."""
        if units <= 0 or not self.frames:
            return 0
        if units >= self.n:
            return self.n_chars
        # the last frame with fewer units before it holds the end of this one
        k = bisect_left(self.frames, units, key=lambda f: f["units"]) - 1
        left, text, start = units - self.frames[k]["units"], self.text(k), self.frames[k]["chars"]
        if k and text[0] in _BLANK and self.text(k - 1)[-1] not in _BLANK:
            left -= 1  # the word that ran to the end of the frame before ends here
        return start + (next(islice(_WORD.finditer(text), left - 1, None)).end() if left else 0)

    def stream(self, start: int = 0, stop: int | None = None) -> Iterator[str]:
        """The text between two code points, frame by frame."""
        stop = self.n_chars if stop is None else stop
        if start >= stop:
            return
        k = bisect_left(self.frames, start + 1, key=lambda f: f["chars"]) - 1
        while k < len(self.frames) and self.frames[k]["chars"] < stop:
            first = self.frames[k]["chars"]
            yield self.text(k)[max(0, start - first):stop - first]
            k += 1

    def signs(self) -> dict[str, int]:
        """First place of each sign, also across frames."""
        found: dict[str, int] = {}
        tail, at = "", 0
        for piece in self.stream():
            text = tail + piece
            for m in _SIGN.finditer(text):
                found.setdefault(m[0], at - len(tail) + m.start())
            tail, at = text[-2:], at + len(piece)
        return found


def draws(id_text: str) -> list[int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"{SEED}:{id_text}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def plan(doc: Framed, marked: bool, id_text: str) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) in code points."""
    h = draws(id_text)
    if not doc.n_chars or marked or h[2] % 100 >= 50:
        return "plain", 0, 0
    a, b = sorted((h[0] % (doc.n + 1), h[1] % (doc.n + 1)))
    return "spm" if h[3] % 100 < 80 else "psm", doc.place(a), doc.place(b)


def output(doc: Framed, form: str, a: int, b: int) -> Iterator[str]:
    """The transformed text as a stream."""
    if form == "plain":
        yield from doc.stream()
        return
    prefix, suffix = (PREFIX, 0, a), (SUFFIX, b, doc.n_chars)
    for sign, start, stop in ((prefix, suffix) if form == "psm" else (suffix, prefix)) + ((MIDDLE, a, b),):
        yield sign
        yield from doc.stream(start, stop)


def restored(out: Framed, form: str) -> Iterator[str]:
    """The text that an output was made from, as a stream."""
    if form == "plain":
        yield from out.stream()
        return
    at = out.signs()
    ends = sorted([*at.values(), out.n_chars])
    for sign in (PREFIX, MIDDLE, SUFFIX):
        start = at[sign]
        yield from out.stream(start + len(sign), ends[ends.index(start) + 1])


def _digest(pieces: Iterable[str]) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p.encode(errors="surrogatepass"))
    return h.hexdigest()


def frame_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> DataFrame:
    """``id_col``, ``n`` units, ``n_chars``, ``marked`` (holds a sign), ``frames``: one row per row of
    ``docs``, in any order. A null text counts as empty: no frames. Other columns are not read."""
    x = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))

    def run(batches):
        packer = _Packer(frame)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            packed = [packer.pack([t]) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for _, n, _ in packed], pa.int32()), pa.array([c for _, _, c in packed], pa.int32()),
                 pa.array([any(s in t for s in SIGNS) for t in texts]), pa.array([f for f, _, _ in packed], _ARROW)],
                names=[id_col, "n", "n_chars", "marked", "frames"])

    return x.mapInArrow(run, StructType([x.schema[id_col], StructField("n", IntegerType()), StructField("n_chars", IntegerType()),
                                         StructField("marked", BooleanType()), StructField("frames", FRAMES)]))


def transform(framed: DataFrame, id_col: str = "doc_id", frame: int = FRAME) -> DataFrame:
    """Apply the fill-in-middle transformation to a ``frame_table``.

    ``id_col``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (null if plain), ``out_chars``
    and ``output`` (frames): a row per row. The id alone draws the cuts, so copies
    under one id are cut alike; a null id draws as the text ``null``.
    """
    x = framed.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("_id"),
                      "n", "n_chars", "marked", "frames")

    def run(batches):
        packer = _Packer(frame)
        for b in slices(batches):
            forms, pre, mid, size, outs = [], [], [], [], []
            for ident, n, n_chars, marked, frames in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                doc = Framed(frames, n, n_chars)
                form, s, e = plan(doc, marked, ident)
                frames, _, chars = packer.pack(output(doc, form, s, e))
                forms.append(form)
                pre.append(None if form == "plain" else s)
                mid.append(None if form == "plain" else e - s)
                size.append(chars)
                outs.append(frames)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(forms, pa.string()), pa.array(pre, pa.int32()), pa.array(mid, pa.int32()),
                 pa.array(size, pa.int32()), pa.array(outs, _ARROW)],
                names=[id_col, "n", "form", "prefix_chars", "middle_chars", "out_chars", "output"])

    ints = [StructField(c, IntegerType()) for c in ("prefix_chars", "middle_chars", "out_chars")]
    return x.mapInArrow(run, StructType([x.schema[id_col], StructField("n", IntegerType()), StructField("form", StringType()), *ints,
                                         StructField("output", FRAMES)]))


def _streamed(out: DataFrame, columns: dict, kind: str, arrow: pa.DataType) -> DataFrame:
    """Add columns made of (output, form) of a ``transform`` result; ``output`` goes."""
    keep = [c for c in out.columns if c != "output"]
    x = out.select(*[F.col(f"`{c}`") for c in keep], "output")

    def run(batches):
        for b in slices(batches):
            forms, sizes, outs = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("form", "out_chars", "output"))
            docs = [(Framed(o, 0, c), f) for f, c, o in zip(forms, sizes, outs, strict=True)]
            made = [pa.array([make(d, f) for d, f in docs], arrow) for make in columns.values()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *made], names=[*keep, *columns])

    return x.mapInArrow(run, StructType([*x.schema.fields[:-1], *[StructField(c, StringType()) for c in columns]]))


def digests(out: DataFrame) -> DataFrame:
    """``output_sha256`` and ``restored_sha256`` in place of ``output``, each streamed from
    the output's frames."""
    return _streamed(out, {"output_sha256": lambda d, f: _digest(d.stream()), "restored_sha256": lambda d, f: _digest(restored(d, f))},
                     "string", pa.string())


def texts(out: DataFrame) -> DataFrame:
    """``output_text`` in place of ``output``: what a training job reads."""
    return _streamed(out, {"output_text": lambda d, f: "".join(d.stream())}, "string", pa.string())


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 13 over whole ``documents``, through the stored frames. Nulls, repeats
    and an empty table as in ``frame_table`` and ``transform``."""
    framed = stored(frame_table(table(spark, sf_dir, "documents")), "frames")
    x = digests(transform(framed))
    longs: list[Column] = [F.col(c).cast("long").alias(c) for c in ("prefix_chars", "middle_chars")]
    return x.select("doc_id", F.col("n").cast("long").alias("n"), "form", *longs, "output_sha256", "restored_sha256")


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '{_UNIT}') AS units,
        [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT, ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS r FROM d),
c AS (SELECT *, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a,
        greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50
          THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
        array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
