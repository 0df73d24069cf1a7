"""Benchmark decontamination by MinHash containment search (operator 7).

A test item is found in a document if at least 80% of its distinct five-word
shingles are in the document (containment, not resemblance, so the length of
the document does not matter).

- Items are partitioned by size (powers of two of their shingle count). A
  document probes only the partitions whose smallest item could fit into it.
- An item of n shingles is sketched by its first n - ceil(0.8 n) + 1 shingles in
  an order that all items share: those that fewer items hold first, then the
  smaller hash. So a phrase that many items have seldom is a sketch, and a
  document with it does not meet them all. A document that holds 80% of the item lacks at most
  n - ceil(0.8 n) of its shingles, so at least one of the sketch is in the
  document: the candidate search loses nothing, however long the document.
- Candidates are verified by the exact share of the item's shingles.

Documents are read once. A fixed table of 2^20 slots (a mask of size
partitions per slot, 4 MB at any size of the benchmark) drops the shingles
that no item can have; what passes is joined by the full hash in Spark.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, columns, slices, stored, table, with_key

SHINGLE = 5
SHARE = 0.8
SLOT_BITS = 20

_WORDS = re.compile(r"[^\W_]+")
_MULT = 0x9E3779B97F4A7C15
_MEMO_WORDS = 500_000


class _Memo(dict):
    """Word -> 64-bit hash; forgets all when it holds too many words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode(errors="surrogatepass"), 7)
        return h


def shingle_hashes(text: str | None, memo: _Memo, k: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles of a text (lower case,
    words are runs of letters and digits); fewer words: the whole sequence."""
    words = _WORDS.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), np.uint64)
    for i in range(min(k, len(h))):
        out = out * np.uint64(_MULT) + h[i:i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def item_shingles(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(``_item``, ``_text_no``, ``hash``, ``n``, ``part``, ``need``): a row per shingle.

    Items that repeat an id with another text are told apart by their row key;
    equal rows count once; an item without words has no row.
    """
    x = with_key(items.select(F.col(item_col).alias("_item"), F.col(text_col).alias("_text"))).dropDuplicates(list(KEY))
    x = x.select("_item", F.col(KEY[0]).alias("_text_no"), "_text")

    def run(batches):
        memo = _Memo()
        for b in batches:
            for item, no, text in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                hs = shingle_hashes(text, memo)
                n = len(hs)
                need = -(-n * 4 // 5)  # SHARE as an exact fraction
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()] * n, b.schema.field(0).type), pa.array([no.as_py()] * n, pa.int64()),
                         pa.array(hs.view(np.int64)), pa.array([n] * n, pa.int32()),
                         pa.array([n.bit_length()] * n, pa.int32()), pa.array([need] * n, pa.int32())],
                        names=["_item", "_text_no", "hash", "n", "part", "need"])

    kind = x.schema["_item"].dataType.simpleString()
    return x.mapInArrow(run, f"_item {kind}, _text_no long, hash long, n int, part int, need int")


def sketched(shingles: DataFrame) -> DataFrame:
    """``item_shingles`` rows with the sketch marked in ``sketch``."""
    held = shingles.groupBy("hash").agg(F.count(F.lit(1)).alias("_held"))
    place = F.row_number().over(Window.partitionBy("_item", "_text_no").orderBy("_held", "hash"))
    return shingles.join(held, "hash").withColumn("sketch", place <= F.col("n") - F.col("need") + 1).drop("_held")


def _slots(shingles: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Mask of size partitions per slot, and (partition, smallest need)."""
    slot = F.shiftrightunsigned("hash", 64 - SLOT_BITS).cast("int")
    rows = shingles.groupBy(slot.alias("s")).agg(F.bit_or(F.expr("shiftleft(1L, part)")).alias("m")).collect()
    mask = np.zeros(1 << SLOT_BITS, np.uint32)
    for r in rows:  # at most 2^20 rows
        mask[r.s] = r.m
    return mask, [(r.part, r.need) for r in shingles.groupBy("part").agg(F.min("need").alias("need")).collect()]


def hits(docs: DataFrame, mask: np.ndarray, parts: list[tuple[int, int]], carry: list[str], text_col: str) -> DataFrame:
    """``carry`` and ``hits``: a document's shingle hashes that an item of a
    size partition within its reach may have; documents without any go."""
    shared = docs.sparkSession.sparkContext.broadcast(mask)
    x = docs.select(*carry, F.col(text_col).alias("_text"))

    def run(batches):
        memo, slots = _Memo(), shared.value
        for b in slices(batches):
            rows, found = [], []
            for i, text in enumerate(b.column("_text").to_pylist()):
                hs = shingle_hashes(text, memo)
                reach = np.uint32(sum(1 << p for p, need in parts if need <= len(hs)))
                hs = hs[(slots[hs >> np.uint64(64 - SLOT_BITS)] & reach) != 0]
                if len(hs):
                    rows.append(i)
                    found.append(hs.view(np.int64))
            if rows:
                at = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(found)))
                kept = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in carry), lists], names=[*carry, "hits"])

    from pyspark.sql.types import ArrayType, LongType, StructField, StructType
    return x.mapInArrow(run, StructType([*(x.schema[c] for c in carry), StructField("hits", ArrayType(LongType()))]))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(row key, id, item, ``shared``, ``item_shingles``, ``containment``): one
    row per document and item it holds at least 80% of.

    Null and empty texts hold nothing and are held by nothing; an item of
    fewer than five words is found where it is the whole text. Repeated rows
    count once, repeated ids with different texts on their own.
    """
    shingles = stored(sketched(item_shingles(items, item_col, item_text_col)), "item-shingles")
    mask, parts = _slots(shingles)
    keyed = docs.select(*[c for c in KEY if c in docs.columns], F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = hits(keyed if KEY[0] in docs.columns else with_key(keyed), mask, parts, [*KEY, "_id"], "_text")
    # repeated rows share a key and have equal hits
    found = stored(found.dropDuplicates(list(KEY)), "hits")
    each = found.select(*KEY, F.explode("hits").alias("hash"))
    item = ["_item", "_text_no"]
    candidates = each.join(shingles.filter("sketch").select(*item, "hash"), "hash").select(*KEY, *item).distinct()
    held = (candidates.withColumn("_i", F.xxhash64(*item)).join(
                shingles.select(F.xxhash64(*item).alias("_i"), F.col("_item").alias("_it"), "hash", "n", "need"), "_i")
            .join(each, [*KEY, "hash"])
            .groupBy(*KEY, "_i", "n", "need").agg(F.count(F.lit(1)).alias("shared"), F.min("_it").alias(item_col))
            .filter("shared >= need"))
    out = held.join(found.select(*KEY, F.col("_id").alias(id_col)), list(KEY))
    return out.select(*KEY, id_col, item_col, "shared", F.col("n").alias("item_shingles"),
                      (F.col("shared") / F.col("n")).alias("containment"))


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 7 over whole ``documents``: the documents with the items they hold."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(*KEY)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go. Null and empty texts stay, repeated rows go
    together, an empty table or benchmark changes nothing; columns may have any name."""
    keyed = with_key(docs)
    bad = contained(keyed, table(spark, sf_dir, "benchmark")).select(*KEY).distinct()
    return keyed.join(bad, list(KEY), "left_anti").select(columns(docs))
