"""Line dedup by winnowing over line hashes (operator 5).

A text is a sequence of lines, compared without surrounding blanks; blank
lines take no part. Of every window of ``w`` lines (of all lines, if they are
fewer) the smallest line hash is selected as a fingerprint, so every run of
``w`` lines that occurs twice has the same fingerprint at the same place of
both (winnowing guarantee).

1. A fingerprint's first position is its anchor; every later position joins it.
2. Each joined position is extended both ways, line by line, to the longest run
   that it shares with the text of the anchor. Positions of one text that meet
   one other text at the same distance lie on one line-up, which is compared once
   from end to end. The runs so found are deleted.
3. A repeated run of fewer than ``w`` lines may hold no fingerprint. The lines that
   are left are compared one by one, and those that an earlier position holds go.

So of every line the first occurrence stays, and no other.

Positions are ordered by (id, row key, line). Every hash group is reduced by
an aggregate to its anchor and joined back, so no pair of two later positions is
formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, columns, let, stored, table, with_key

WINDOW = 4


def line_sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row key, ``_id``, ``_at``: line numbers, ``_hash``: line hashes) of the
    non-blank lines, a row per distinct row of ``docs``."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line")))
    x = docs.select(*KEY, F.col(id_col).alias("_id"), F.filter(marked, lambda x: x["line"] != "").alias("_lines"))
    x = x.select(*KEY, "_id", F.col("_lines.at").alias("_at"),
                 F.transform("_lines", lambda x: F.xxhash64(x["line"])).alias("_hash"))
    return x.filter(F.size("_hash") > 0).dropDuplicates(list(KEY))


def selected(hashes: Column, w: int = WINDOW) -> Column:
    """Places of the window minima, the last of equal ones."""
    n = F.size(hashes)
    starts = F.sequence(F.lit(0), F.greatest(n - w, F.lit(0)))

    def least(s: Column) -> Column:
        return let(F.slice(hashes, s + 1, w), lambda run: s + F.size(run) - F.array_position(
            F.reverse(run), F.array_min(run)).cast("int"))

    return F.array_distinct(F.transform(starts, least))


def _place(at: str) -> Column:
    return F.struct(F.col("_id").isNull().alias("nil"), F.col("_id").alias("id"), *KEY, F.col(at).alias("at"))


def _later(x: DataFrame) -> DataFrame:
    """Rows (row key, ``_id``, ``_p``, ``_h``) whose hash an earlier place holds, with the first place ``_first``."""
    first = x.groupBy("_h").agg(F.min(_place("_p")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = first.select("_h", *[F.col(f"_first.{k}").alias(f"_f{i}") for i, k in enumerate(KEY)], F.col("_first.at").alias("_fp"))
    own = (F.col("_f0") == F.col(KEY[0])) & (F.col("_f1") == F.col(KEY[1])) & (F.col("_fp") == F.col("_p"))
    return x.join(first, "_h").filter(~own)


def runs(seq: DataFrame, w: int = WINDOW) -> DataFrame:
    """(row key, ``_gone``: places) of the later repeated runs around the fingerprints."""
    marks = seq.select(*KEY, "_id", F.explode(F.transform(selected(F.col("_hash"), w), lambda p: F.struct(
        p.alias("_p"), F.get("_hash", p).alias("_h")))).alias("_m")).select(*KEY, "_id", "_m._p", "_m._h")
    met = _later(marks).withColumn("_off", F.col("_p") - F.col("_fp"))
    lines = met.groupBy(*KEY, "_f0", "_f1", "_off").agg(F.collect_set("_p").alias("_ps"))  # places of one text
    ours = seq.select(*KEY, F.col("_hash").alias("_a"))
    theirs = seq.select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(KEY)], F.col("_hash").alias("_b"))
    x = lines.join(ours, list(KEY)).join(theirs, ["_f0", "_f1"])
    # places whose line equals the one at the same distance; a run reaches from a mark to the next unequal line
    differ = F.filter(F.sequence(F.lit(0), F.size("_a") - 1), lambda i: ~F.get("_a", i).eqNullSafe(F.get("_b", i - F.col("_off"))))

    def around(differ: Column) -> Column:
        walls = F.concat(F.array(F.lit(-1)), differ, F.array(F.size("_a")))
        inside = F.transform(F.slice(walls, F.lit(1), F.size(walls) - 1), lambda v, k: F.struct(v.alias("lo"), F.get(walls, k + 1).alias("hi")))
        hit = F.filter(inside, lambda r: F.exists("_ps", lambda p: (p > r["lo"]) & (p < r["hi"])))
        return F.flatten(F.transform(hit, lambda r: F.sequence(r["lo"] + 1, r["hi"] - 1)))

    x = x.select(*KEY, let(differ, around).alias("_run"))
    return x.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("_run"))).alias("_gone"))


def repeated_lines(seq: DataFrame, w: int = WINDOW) -> DataFrame:
    """(row key, ``_gone``: places among the non-blank lines) of all lines that an earlier
    place holds; texts without any have no row. Ties cannot arise: rows equal in every
    column are one text, and its places differ."""
    x = seq.join(stored(runs(seq, w), "runs"), list(KEY), "left")
    x = stored(x.withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>"))), "lines-left")
    every = F.sequence(F.lit(0), F.size("_hash") - 1)
    rest = x.select(*KEY, "_id", F.explode(F.transform(F.array_except(every, F.col("_gone")), lambda p: F.struct(
        p.alias("_p"), F.get("_hash", p).alias("_h")))).alias("_m")).select(*KEY, "_id", "_m._p", "_m._h")
    single = _later(rest).groupBy(*KEY).agg(F.collect_list("_p").alias("_more"))
    x = x.select(*KEY, "_gone").join(single, list(KEY), "left")
    x = x.withColumn("_gone", F.concat("_gone", F.coalesce("_more", F.array().cast("array<int>")))).drop("_more")
    return x.filter(F.size("_gone") > 0)


def dedup_lines(docs: DataFrame, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the later repeated lines taken out of
    ``text_col``, plus ``n_lines``, ``n_removed`` and ``removed`` (line numbers).

    A null text stays null. Rows that are equal in every column are one
    document and change alike; ids may repeat or be null (null ids come last).
    Deleting all lines leaves an empty text.
    """
    keyed = with_key(docs)
    seq = stored(line_sequences(keyed, id_col, text_col), "lines")
    gone = repeated_lines(seq, w)
    gone = gone.join(seq.select(*KEY, "_at"), list(KEY)).select(
        *KEY, F.array_sort(F.transform("_gone", lambda i: F.get("_at", i))).alias("_removed"))
    x = keyed.join(gone, list(KEY), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_removed"))
    text = F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(
        F.array_join(let(lines, lambda x: F.transform(kept, lambda i: F.get(x, i))), "\n"))
    none = F.array().cast("array<int>")
    return x.select(*[text.alias(c) if c == text_col else k for k, c in zip(columns(docs), docs.columns, strict=True) if c not in ("n_lines", "n_removed", "removed")],
                    F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
                    F.coalesce(F.size(F.coalesce("_removed", none)), F.lit(0)).alias("n_removed"),
                    F.coalesce("_removed", none).alias("removed"))


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 5 over whole ``documents``."""
    x = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
                    F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


# By brute force: every line against all earlier ones.
SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos
           FROM documents),
g AS (SELECT doc_id, pos FROM l WHERE trim(line, ' ') <> ''
      QUALIFY row_number() OVER (PARTITION BY trim(line, ' ') ORDER BY doc_id, pos) > 1),
t AS (SELECT l.doc_id, count(*) FILTER (g.pos IS NOT NULL) AS n_removed,
        string_agg(l.pos::VARCHAR, ',' ORDER BY l.pos) FILTER (g.pos IS NOT NULL) AS removed,
        string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed,
  coalesce(removed, '') AS removed, sha256(coalesce(kept, '')) AS text_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""
