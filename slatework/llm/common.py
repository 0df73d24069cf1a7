"""Helpers that the operators of this folder share.

Row identity. A table may repeat a document id, hold null ids or repeat whole
rows. Where an operator must find a row of its input again it uses
``row_key``: two 64-bit hashes over all columns, so only rows that are equal
in every column share a key, and those are interchangeable.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

KEY = ("__row_key_a", "__row_key_b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors and is computed once."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{ensure_checkpoint_dir(spark)}/slatework-{app}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 256):
    """Cut the Arrow batches of a task into batches of ``rows`` whole texts."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever signs their names hold."""
    return [F.col(_quoted(c)) for c in df.columns]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def key_columns(df: DataFrame) -> dict[str, Column]:
    """The row key's columns; maps, which have no hash, count by their JSON text."""
    def hashable(name: str) -> Column:
        c = F.col(_quoted(name))
        kind = df.schema[name].dataType.simpleString()
        return F.to_json(F.struct(c.alias("v"))) if "map<" in kind or kind in ("variant", "interval") else c

    parts = [x for c in df.columns for x in (hashable(c), F.col(_quoted(c)).isNull())]
    return {k: F.xxhash64(F.lit(i), *parts) for i, k in enumerate(KEY)}


def with_key(df: DataFrame) -> DataFrame:
    """Add the row key to ``df``; its two names are the only ones a table may not use."""
    if set(KEY) & set(df.columns):
        raise ValueError(f"columns {KEY} are reserved")
    return df.withColumns(key_columns(df))


def rejoin(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` for the rows of ``decided`` (row key, further columns).

    ``docs`` is reduced to one row per key first, so a key decided n times
    gives n rows: as many as it had copies, or as an operator repeats it.
    Keys that ``decided`` lacks go. One shuffle of ``docs``.
    """
    one = with_key(docs).dropDuplicates(list(KEY))
    return one.join(decided, list(KEY), "inner").drop(*KEY)


def running(df: DataFrame, keys: Sequence[str], u: Column, order: Sequence[Column | str], value: Column,
            out: str, cells: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys`` that
    come earlier in ``order``.

    ``u`` in [0, 1) must not decrease along ``order``; it cuts each key into
    ``cells`` cells, so no task sorts more than one cell of one key. Totals
    per cell are summed over a table of at most keys x cells rows. ``keys``
    must not be null. Rows that tie in ``order`` get distinct places in an
    unspecified order: pass an order in which only equal rows tie.
    """
    x = df.withColumn("_cell", F.least(F.floor(u * cells), F.lit(cells - 1)).cast("int"))
    per = x.groupBy(*keys, "_cell").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    y = x.join(per, [*keys, "_cell"], "inner")
    return y.withColumn(out, (F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop(
        "_cell", "_before")


def cell_count(rows: int, per_cell: int = 2000, most: int = 10_000_000) -> int:
    """Cells for ``rows`` rows. One task sums a row per cell, which bounds them; beyond
    ``most``, at 20 billion rows, the cells grow instead."""
    return max(1, min(most, -(-rows // per_cell)))


def seeded(seed: int, *cols: Column) -> Column:
    """Hex digest that orders rows at random but alike in every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))


def unit(digest: Column) -> Column:
    """First 32 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_key(col: Column) -> Column:
    """Source as a non-null key in code point order, null last."""
    return F.coalesce(F.concat(F.lit("0"), col.cast("string")), F.lit("1"))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    it = iter(frames)
    out = next(it)
    for f in it:
        out = out.unionByName(f)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it
    inside further lambdas (Spark would compute it again for every element)."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
