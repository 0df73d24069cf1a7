"""Proportional stratified interleaving (operator 4).

Every source is shuffled with a seed and its rows get the fractional rank
(rank + 1/2) / n; all rows are sorted by that fraction and the sorted line is
cut into equal shards. A source with a share p of the rows then has a share
p of every stretch of the line, up to one row, so every shard has the mixture
of the whole. The law is ``rows``: shard counts differ by one at most.

Both rankings are running counts over cells (common.running): a source that
holds a third of all rows is cut into as many cells as the table needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, cell_count, columns, rejoin, running, seeded, source_key, stored, table, unit, with_key

SHARDS = 40
SEED = 20240229


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (UTF-8 bytes + 16; a null text
    has none), ``text_crc32`` (null for a null text), ``shard``, ``slot``
    (gapless from 0 within the shard) and ``carry``.

    Null ids and null sources are ordinary values (null is a source of its
    own). Repeated rows get places of their own; rows that tie in id, checksum
    and size are interchangeable. An empty table gives an empty table.
    """
    text = F.col(text_col)
    x = stored(docs.select(
        id_col, *carry, source_key(F.col(source_col)).alias("_src"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        seeded(seed, F.col(id_col), F.crc32(text.cast("binary"))).alias("_h")), "shard-rows")
    per = x.groupBy("_src").agg(F.count(F.lit(1)).alias("_n"))
    total = x.count()
    cells = cell_count(total)
    tie = ["_h", "text_crc32", "size"]
    ranked = running(x, ["_src"], unit(F.col("_h")), tie, F.lit(1), "_rank", cells).join(per, "_src")
    ranked = stored(ranked.withColumn("_frac", (2 * F.col("_rank") + 1) / (2 * F.col("_n"))).drop("_n", "_rank"),
                    "shard-ranks")
    line = running(ranked, [], F.col("_frac"), ["_frac", "_src", *tie], F.lit(1), "_pos", cells)
    line = line.withColumn("shard", F.expr(f"cast(_pos * {shards} div {max(1, total)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return line.select(id_col, "size", "text_crc32", "shard", (F.col("_pos") - first).alias("slot"), *carry)


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 4 over whole ``documents``."""
    x = assign(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its ``shard`` and ``slot`` (own columns of that name go). Null ids,
    sources and texts are ordinary values; repeated rows get places of their own; an
    empty table passes."""
    kept = [x for x, c in zip(columns(docs), docs.columns, strict=True) if c not in ("shard", "slot")]
    x = assign(with_key(docs), carry=KEY).select(*KEY, "shard", "slot")
    return rejoin(docs, x.withColumnsRenamed({"shard": "_shard", "slot": "_slot"})).select(
        *kept, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
