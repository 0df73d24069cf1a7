"""Mixing sources to target weights by Sainte-Lague apportionment (operator 6).

1. Targets. Sources in code point order (null last) weigh 1, 2, 3, 1, ...
   and share the words of the whole table. A target stops at three times its
   source's words; the excess goes to the others by weight. Sorted by the
   ratio of limit to weight, the sources that stop come first, so the common
   level follows from running sums.
2. Quotas. The mix is counted in blocks of equal words. The blocks go to the
   sources by highest quotients target / (2 k + 1). Shard j ends after H_j
   blocks of that sequence; the method is house-monotone, so the differences
   of the seats at H_j are the integer quotas per shard. Seats are not dealt
   one by one: with n sources and divisor multipliers 1 -+ n / 2H the rounded
   shares bound the result from below and above, and only the seats between
   (2 n or so) are ranked by their quotients.
3. Selection. Within a source the rows are shuffled with a seed and their
   words form one ring of blocks, entered at a seeded block; the shards take
   their quotas one after the other around the ring, up to three times.
   What a row gives is the overlap of its words with the blocks taken.

The word offsets are running sums over cells (common.running), so a source
that holds a third of all words is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, cell_count, columns, rejoin, running, seeded, source_key, stored, table, unit, with_key

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 64  # words; smaller where the table has fewer than 4,096 such blocks
FINEST = 4096
SHARDS = 8
LIMIT = 3  # times a source's words
SEED = 20240302


def words(text: Column) -> Column:
    """Number of words: starts of runs of non-blanks."""
    blanks = " \t\n\x0b\x0c\r"
    flat = F.trim(F.translate(text, blanks, " " * 6))
    runs = F.regexp_replace(flat, " {2,}", " ")
    n = F.length(runs) - F.length(F.translate(runs, " ", "")) + 1
    return F.when(F.coalesce(F.length(flat), F.lit(0)) == 0, 0).otherwise(n).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(``_src``, ``source_size``) -> those, ``weight``, ``total``, ``target``.

    One row per source; windows over that table only. Sources without words
    have target 0.
    """
    rank = F.row_number().over(Window.orderBy("_src"))
    everything = Window.partitionBy()
    x = sizes.withColumns({"weight": ((rank - 1) % 3 + 1).cast("double"),
                           "total": F.sum("source_size").over(everything)})
    x = x.withColumns({"_cap": LIMIT * F.col("source_size")}).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    before = Window.orderBy("_ratio", "_src").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("_ratio", "_src").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = x.withColumn("_level", (F.col("total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
                     / F.sum("weight").over(onward))
    # below the true level every earlier source stops; the first that does not gives the level
    x = x.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_src", "_level")))
                     .over(everything)["_level"])
    return x.select("_src", "source_size", "weight", "total",
                    F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight"))
                    .alias("target"))


def quotas(shares: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """``targets`` rows -> one row per source and shard: ``block`` (its words),
    ``blocks`` (of the source), ``seats`` (up to this shard), ``quota``."""
    x = shares.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"total div {FINEST}"))).cast("long"))
    x = x.withColumns({"blocks": F.expr("(source_size + block - 1) div block"),
                       "_n": F.count(F.lit(1)).over(Window.partitionBy()),
                       "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    x = x.withColumn("_house", F.expr(f"(total div block) * (shard + 1) div {shards}"))
    share = F.when(F.col("total") > 0, F.col("target") / F.col("total") * F.col("_house")).otherwise(0.0)
    slack = F.col("_n") / (2 * F.greatest(F.col("_house"), F.lit(1)))
    x = x.withColumns({"_low": F.greatest(F.floor(F.greatest(1 - slack, F.lit(0.0)) * share + 0.5) - 1, F.lit(0)),
                       "_high": F.floor((1 + slack) * share + 0.5) + 1})
    x = x.withColumn("_open", F.col("_house") - F.sum("_low").over(Window.partitionBy("shard")))
    open_seats = x.filter("target > 0").select(
        "shard", "_src", "_open", "target", F.explode(F.sequence("_low", "_high")).alias("_k"))
    order = Window.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("_k") + 1)), "_src", "_k")
    won = (open_seats.withColumn("_place", F.row_number().over(order)).filter("_place <= _open")
           .groupBy("shard", "_src").agg(F.count(F.lit(1)).alias("_won")))
    x = x.join(won, ["shard", "_src"], "left")
    x = x.withColumn("seats", F.least(F.col("_low") + F.coalesce("_won", F.lit(0)), LIMIT * F.col("blocks")))
    by_shard = Window.partitionBy("_src").orderBy("shard")
    return x.select("_src", "source_size", "target", "block", "blocks", "shard", "seats",
                    (F.col("seats") - F.coalesce(F.lag("seats").over(by_shard), F.lit(0))).alias("quota"))


def mix(docs: DataFrame, seed: int = SEED, block: int = BLOCK, shards: int = SHARDS, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (words; 0 for a null text),
    ``source_size``, ``target``, ``taken`` (words, repeats counted, at most
    three times ``size``), ``shard`` (the one whose quota reaches the row's first
    word first; null if none does) and ``carry``.

    Null ids and sources are ordinary values; repeated rows give on their own;
    a row without words gives nothing. An empty table gives an empty table.
    """
    text = F.col(text_col)
    x = stored(docs.select(id_col, *carry, source_key(F.col(source_col)).alias("_src"), words(text).alias("size"),
                           F.crc32(text.cast("binary")).alias("_crc"), seeded(seed, F.col(id_col), F.md5(text.cast("binary"))).alias("_h")),
               "mix-rows")
    shares = targets(x.groupBy("_src").agg(F.sum("size").alias("source_size")))
    taken = quotas(shares, shards, block).groupBy("_src", "source_size", "target", "block", "blocks").agg(
        F.max("seats").alias("_seats"), F.array_sort(F.collect_list(F.struct("shard", "seats"))).alias("_upto"))
    start = F.conv(F.substring(seeded(seed, F.col("_src")), 1, 8), 16, 10).cast("long")
    taken = stored(taken.withColumn("_start", F.when(F.col("blocks") > 0, start % F.col("blocks")).otherwise(0)),
                   "mix-quotas")
    x = running(x, ["_src"], unit(F.col("_h")), ["_h", "_crc", "size"], F.col("size"), "_at", cell_count(x.count()))
    x = x.join(taken, "_src")
    rest = F.expr("if(blocks > 0, _seats % blocks, 0)")
    full = F.expr("if(blocks > 0, _seats div blocks, 0)")
    lo = F.col("_start") * F.col("block")
    hi = (F.col("_start") + rest) * F.col("block")
    turn = F.greatest(F.lit(0), F.col("_start") + rest - F.col("blocks")) * F.col("block")

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(b, F.col("_at") + F.col("size")) - F.greatest(a, F.col("_at")))

    # the block of the row's first word, counted around the ring from where the shards enter
    turn_at = F.expr("if(blocks > 0 and size > 0, (_at div block - _start + blocks) % blocks, null)")
    passed = F.size(F.filter("_upto", lambda s: s["seats"] <= F.col("_turn_at")))
    x = x.withColumn("_turn_at", turn_at).withColumn("shard", F.when(F.col("_turn_at") < F.col("_seats"), passed).cast("int"))
    got = full * F.col("size") + overlap(lo, F.least(hi, F.col("source_size"))) + overlap(F.lit(0), turn)
    return x.select(id_col, "size", "source_size", "target", got.cast("long").alias("taken"), "shard", *carry)


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 6 over whole ``documents``."""
    return mix(table(spark, sf_dir, "documents"))


# The same results by other means: every seat is dealt one by one, offsets
# come from plain windows, words from a pattern.
SQL = rf"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         coalesce('0' || source, '1') AS src, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')) AS h
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::DOUBLE AS w
      FROM d GROUP BY src),
t AS (SELECT *, (SELECT sum(source_size) FROM s)::BIGINT AS total, {LIMIT} * source_size AS cap FROM s),
lv AS (SELECT a.src, a.cap / a.w AS ratio,
         (a.total - coalesce((SELECT sum(b.cap) FROM t b WHERE (b.cap / b.w, b.src) < (a.cap / a.w, a.src)), 0)::BIGINT)
         / (SELECT sum(b.w) FROM t b WHERE (b.cap / b.w, b.src) >= (a.cap / a.w, a.src)) AS level FROM t a),
l AS (SELECT level FROM lv WHERE level <= ratio ORDER BY ratio, src LIMIT 1),
g AS (SELECT src, source_size, total, least(cap::DOUBLE, level * w) AS target,
        greatest(1, least({BLOCK}, total // {FINEST})) AS block FROM t, l),
dealt AS (SELECT src, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, src, k) AS place, total // block AS house
          FROM (SELECT *, unnest(range(0, (target / block)::BIGINT + 30)) AS k FROM g WHERE target > 0)),
seat AS (SELECT src, count(*) AS seats FROM dealt WHERE place <= house GROUP BY src),
per AS (SELECT src, j, count(*) FILTER (WHERE place <= house * (j + 1) // {SHARDS}) AS seats FROM dealt, range(0, {SHARDS}) t(j) GROUP BY src, j),
up AS (SELECT src, list(seats ORDER BY j) AS upto FROM per GROUP BY src),
q AS (SELECT g.*, (source_size + block - 1) // block AS blocks,
        least(coalesce(seats, 0), {LIMIT} * ((source_size + block - 1) // block)) AS seats,
        ('0x' || substr(md5('{SEED}:' || g.src), 1, 8))::BIGINT AS pick FROM g LEFT JOIN seat USING (src)),
r AS (SELECT src, source_size, target, block, blocks, seats // greatest(blocks, 1) AS whole,
        seats % greatest(blocks, 1) AS rest, pick % greatest(blocks, 1) AS start FROM q),
o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY src ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        ::BIGINT AS pos FROM d)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (whole * size
   + greatest(0, least(least((start + rest) * block, source_size), pos + size) - greatest(start * block, pos))
   + greatest(0, least(greatest(0, start + rest - blocks) * block, pos + size) - pos))::BIGINT AS taken,
  (CASE WHEN size > 0 AND (pos // block - start + blocks) % blocks < whole * blocks + rest
        THEN len(list_filter(upto, lambda s: least(s, {LIMIT} * blocks) <= (pos // block - start + blocks) % blocks)) END)::INT AS shard
FROM o JOIN r USING (src) LEFT JOIN up USING (src)
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: each row as often as the mix takes its words,
    rounded to whole copies (only the rows at the two ends of a source's ring
    section are taken in part). Rows taken less than half a time go, and so do null
    and empty texts, which have no words to give. Repeated rows are taken on their
    own; an empty table passes; columns may have any name but the row key's."""
    x = mix(with_key(docs), carry=KEY).filter("size > 0")
    x = x.select(*KEY, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_copies")).filter("_copies > 0")
    return rejoin(docs, x.select(*KEY, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))).select(columns(docs))
