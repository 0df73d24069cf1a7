"""Substring dedup by hashing normalised units (operator 8).

A unit is a line, cut further after sentence ends, because a repeated passage
may stand in the middle of a line. A sentence or line of ``LEAST`` words is a
unit by itself. One of fewer words means little alone. In a run of such parts,
over line ends too, each is a unit whose digest covers those after it up to
``LEAST`` words (at the end of the run: those before it), so a passage of
short lines or sentences is found whatever stands around it, but for its last
parts of under ``LEAST`` words if other short ones follow. A run that has no
second stretch of so many words is one unit. In a run of fewer than ``LEAST``
words a sentence's digest covers the longer one before it in its line (at the
start of a line: after it), and a line by itself is no unit unless it is the
whole text. Units are compared as lower-case runs of letters and digits.

The digests of all units are grouped globally. The first occurrence by (id,
row key, offset) stays, every other goes; the offsets are those of the
original text, in code points, and are kept in the result. No group is
gathered: repeated digests are found by a count, their first place by a
minimum, and both are joined back.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import KEY, columns, slices, stored, table, with_key

LEAST = 8  # words of a unit

_PARTS = re.compile(r"[^.!?\n]*[.!?\n]+[^\S\n]*|[^.!?\n]+")
_WORDS = re.compile(r"[^\W_]+")


def _parts(text: str) -> list[tuple[int, int, list[str], int]]:
    """(start, end, words, line) of the parts with words; those without go to a
    neighbour in their line."""
    parts: list[tuple[int, int, list[str], int]] = []
    line, lead = 0, None
    for m in _PARTS.finditer(text):
        words = _WORDS.findall(m[0].lower())
        if words:
            parts.append((m.start() if lead is None else lead, m.end(), words, line))
            lead = None
        elif parts and parts[-1][3] == line:
            parts[-1] = (parts[-1][0], m.end(), *parts[-1][2:])
        elif lead is None:
            lead = m.start()
        if "\n" in m[0]:
            line, lead = line + 1, None
    return parts


def units(text: str, least: int = LEAST) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the units of a text, in order."""
    out: list[tuple[int, int, bytes]] = []
    parts = _parts(text)
    own = [" ".join(words).encode(errors="surrogatepass") for _, _, words, _ in parts]
    sizes = [len(words) for _, _, words, _ in parts]

    def window(sign: bytes, lo: int, hi: int) -> bytes:
        return xxhash.xxh3_128_digest(sign + b"\n".join(own[lo:hi]))

    def put(k: int, digest: bytes) -> None:
        out.append((parts[k][0], parts[k][1], digest))

    def reach(k: int, step: int, lo: int, hi: int) -> int | None:
        """The nearest place from k on (by ``step``) with ``least`` words between."""
        n = 0
        while lo <= k < hi:
            n += sizes[k]
            if n >= least:
                return k
            k += step
        return None

    def many(lo: int, hi: int) -> None:
        if reach(lo, 1, lo, hi) == hi - 1:
            out.append((parts[lo][0], parts[hi - 1][1], window(b"=", lo, hi)))
            return
        for k in range(lo, hi):
            if (m := reach(k, 1, lo, hi)) is not None:
                put(k, window(b"=", k, m + 1))
            elif (m := reach(k, -1, lo, hi)) is not None:
                put(k, window(b"~", m, k + 1))
            else:
                put(k, window(b"#%d\n" % (k - lo), lo, hi))

    def few(lo: int, hi: int) -> None:
        if lo == 0 and hi == len(parts):
            out.append((parts[0][0], parts[-1][1], window(b"=", lo, hi)))
            return
        k = lo
        if lo:
            last = xxhash.xxh3_128_digest(own[lo - 1])
            while k < hi and parts[k][3] == parts[lo - 1][3]:
                last = xxhash.xxh3_128_digest(b">" + last + own[k])
                put(k, last)
                k += 1
        if hi < len(parts):
            after = xxhash.xxh3_128_digest(own[hi])
            for j in reversed(range(k, hi)):
                if parts[j][3] != parts[hi][3]:
                    break
                after = xxhash.xxh3_128_digest(b"<" + after + own[j])
                put(j, after)

    at = 0
    while at < len(parts):
        end = at
        while end < len(parts) and sizes[end] < least:
            end += 1
        if end == at:
            put(at, xxhash.xxh3_128_digest(own[at]))
            end += 1
        elif sum(sizes[at:end]) >= least:
            many(at, end)
        else:
            few(at, end)
        at = end
    return sorted(out)


def unit_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row key, ``_id``, ``_start``, ``_end``, ``_d1``, ``_d2``): the units of each distinct
    row as arrays (offsets and 128-bit digests); rows without units go."""
    x = docs.select(*KEY, F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    carry = [*KEY, "_id"]

    def lists(at, values, kind):
        return pa.ListArray.from_arrays(at, pa.array(values, kind))

    def run(batches):
        for b in slices(batches):
            rows, at, spans, digests = [], [0], [], []
            for i, text in enumerate(b.column("_text").to_pylist()):
                found = units(text) if text else []
                if found:
                    rows.append(i)
                    spans += [(s, e) for s, e, _ in found]
                    digests += [d for _, _, d in found]
                    at.append(len(spans))
            if rows:
                offsets = pa.array(at, pa.int32())
                se = np.array(spans, np.int32)
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                kept = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(c) for c in carry), lists(offsets, se[:, 0], pa.int32()), lists(offsets, se[:, 1], pa.int32()),
                     lists(offsets, d[:, 0], pa.int64()), lists(offsets, d[:, 1], pa.int64())],
                    names=[*carry, "_start", "_end", "_d1", "_d2"])

    fields = [x.schema[c] for c in carry]
    fields += [StructField(c, ArrayType(t)) for c, t in
               (("_start", IntegerType()), ("_end", IntegerType()), ("_d1", LongType()), ("_d2", LongType()))]
    return x.mapInArrow(run, StructType(fields))


def later_units(found: DataFrame) -> DataFrame:
    """(row key, ``_removed``): sorted (start, end) of the units that occurred before."""
    x = found.select(*KEY, "_id", F.inline(F.arrays_zip("_d1", "_d2", "_start", "_end")))
    # what is joined back is stored first: a join with a stored table, unlike one with an aggregate
    # on the join's own key, can be split by Spark where one digest has most of the units
    repeated = stored(x.groupBy("_d1").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_d1"), "repeated-digests")
    x = stored(x.join(repeated, "_d1", "left_semi"), "repeated-units")
    place = F.struct(F.col("_id").isNull().alias("nil"), F.col("_id").alias("id"), *KEY, F.col("_start").alias("at"))
    first = x.groupBy("_d1", "_d2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = stored(first.drop("_n"), "first-places")
    own = (F.col(f"_first.{KEY[0]}") == F.col(KEY[0])) & (F.col(f"_first.{KEY[1]}") == F.col(KEY[1])) & (F.col("_first.at") == F.col("_start"))
    gone = x.join(first, ["_d1", "_d2"]).filter(~own)
    return gone.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(
        F.col("_start").alias("start"), F.col("_end").alias("end")))).alias("_removed"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` without the later units in ``text_col``, plus
    ``removed`` (start, end in the original text).

    A null text stays null. Rows that are equal in every column are one
    document and change alike, so copies under other ids lose their text to
    the first; null ids come last.
    """
    keyed = with_key(docs)
    found = stored(unit_table(keyed, id_col, text_col).dropDuplicates(list(KEY)), "units")
    x = keyed.join(later_units(found), list(KEY), "left")
    text = F.col(text_col)
    # kept stretches lie between the removed ones
    starts = F.concat(F.array(F.lit(0)), F.col("_removed.end"))
    ends = F.concat(F.col("_removed.start"), F.array(F.length(text)))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")),
                                    lambda z: F.substring(text, z["a"] + 1, z["b"] - z["a"])), "")
    none = F.array().cast("array<struct<start:int,end:int>>")
    clean = F.when(F.col("_removed").isNull(), text).otherwise(kept)
    return x.select(*[clean.alias(c) if c == text_col else k for k, c in zip(columns(docs), docs.columns, strict=True) if c != "removed"],
                    F.coalesce("_removed", none).alias("removed"))


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 8 over whole ``documents``."""
    x = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    chars = F.aggregate("removed", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return x.select("doc_id", F.size("removed").alias("n_removed"), chars.cast("long").alias("chars_removed"),
                    F.array_join(spans, ",").alias("removed"),
                    F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
