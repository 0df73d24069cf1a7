"""Batches whose requests depend on one another.

``in_time_order``: a request's outcome depends on the outcomes of earlier requests of
other keys (who holds a name by then, whether the actor is still an admin), so no
single key orders them. Groups of at most ``GROUP`` requests are applied one by
one, each group in one task; larger ones slice by slice, with what has changed
carried from slice to slice.

``first_wins``: of the requests that pass the checks, the first per key takes effect.

Both number the rows first (``numbered``): the number tells requests with the
same id apart and is stored, so no retry changes it and the checks before it
run once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path, stored
from . import scan

ACCEPTED = "accepted"
GROUP = 100_000  # requests that are applied one by one in one task
LEAST = 16  # requests of a slice, whatever ``most`` is


def numbered(requests: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Store the rows with a unique ``_row``."""
    return stored(requests.withColumn("_row", F.monotonically_increasing_id()), name, tidy)


def first_wins(judged: DataFrame, keys: Sequence[str], code: str, field: str,
               order: Sequence[str] = ("requested_at", "id")) -> DataFrame:
    """Of the rows with verdict ``accepted`` only the first per ``keys`` keeps it; the others
    get ``code`` and ``field``. ``_row`` breaks ties between rows equal in ``order``.

    The keys with several such rows come from a count with map-side partial sums, so
    a hot key costs one row per task. They and their winners are stored: they meet
    the rows by broadcast where Spark finds them small.
    """
    x = numbered(judged, "judged")
    passed = x.filter(F.col("verdict") == ACCEPTED)

    def renamed(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *more)

    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    several = stored(renamed(passed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)), "several")
    won = passed.join(several, same, "left_semi").groupBy(*keys).agg(F.min(F.struct(*order, "_row")).alias("_won"))
    won = stored(renamed(won.withColumn("_first", F.col("_won._row")), "_first"), "won")
    lost = (F.col("verdict") == ACCEPTED) & (F.col("_row") != F.col("_first"))
    return x.join(won, same, "left").select(*[
        F.when(lost, F.lit(code)).otherwise(F.col(c)).alias(c) if c == "verdict" else
        F.when(lost, F.lit(field)).otherwise(F.col(c)).alias(c) if c == "field" else F.col(c) for c in judged.columns])


def in_time_order(rows: DataFrame, group: str, order: Sequence[str], replay: Callable[[list[dict]], list[dict]],
                  carry: Callable[[DataFrame, dict[str, DataFrame]], dict[str, DataFrame]],
                  resume: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], most: int = GROUP) -> DataFrame:
    """Outcomes of requests as if applied one by one within each ``group``.

    ``rows`` are stored and narrow, and carry what their requests find at first. A
    group of at most ``most`` rows goes to ``replay`` (its rows in ``order`` as
    dicts; it gives the changed columns of each), so Spark holds no more than that
    in one task. A larger one goes there slice by slice, all such groups side by
    side: ``carry`` gives the tables of what the requests so far have changed, from
    a slice's outcomes and the former tables, and ``resume`` puts that into the next
    slice's rows. Every row is replayed once.
    """
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    large = stored(sizes.select("_g"), "large-groups")
    same = F.col(group).eqNullSafe(F.col("_g"))
    small, rest = rows, None
    if not large.isEmpty():
        small, rest = rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        made = replay(table.to_pylist())
        for c in made[0] if made else ():
            at = table.schema.get_field_index(c)
            table = table.set_column(at, table.schema.field(at), pa.array([r[c] for r in made], table.schema.field(at).type))
        return table

    def replayed(x: DataFrame) -> DataFrame:
        return x.select(rows.columns).groupBy(group).applyInArrow(run, rows.schema)

    done = stored(replayed(small), "in-time-order")
    if rest is None:
        return done
    spark, path, out = rows.sparkSession, fresh_path(rows.sparkSession, "slices"), fresh_path(rows.sparkSession, "outcomes")
    _sliced(rest, group, order, most).write.partitionBy("_slice").parquet(path)
    last = spark.read.parquet(path).agg(F.max("_slice")).first()[0]
    state: dict[str, DataFrame] = {}
    for k in range(last + 1):
        part = spark.read.schema(rows.schema).parquet(f"{path}/_slice={k}")
        replayed(resume(part, state) if state else part).write.parquet(f"{out}/_slice={k}")
        if k < last:
            state = {n: stored(x, n) for n, x in carry(spark.read.schema(rows.schema).parquet(f"{out}/_slice={k}"), state).items()}
    return done.unionByName(spark.read.schema(rows.schema).parquet(out).select(rows.columns))


def _sliced(rows: DataFrame, group: str, order: Sequence[str], most: int) -> DataFrame:
    """Add ``_slice``: 0 for the first ``most`` (``LEAST`` at least) rows of a group in ``order``, 1 for the next, and so on.

    The groups are larger than ``most``, so the segments are few (a row per group
    and partition of the range partitioning) and are broadcast."""
    x = scan.positions(rows, [group], order)
    seg = x.groupBy(F.col(group).alias("_g"), F.col("_pid").alias("_p")).agg(F.min("_pos").alias("_p0"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_p0")).drop("_n", "_p0")
    y = x.join(F.broadcast(seg), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_pid") == F.col("_p")))
    return y.select(*rows.columns, F.floor((F.col("_off") + F.col("_pos")) / max(most, LEAST)).cast("int").alias("_slice"))
