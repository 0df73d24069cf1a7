"""Merkle-tree document fingerprints (operator 9).

Leaves are the parts of a paragraph: a text is cut after line ends and after
sentence ends, and within longer parts every 48 characters. A section ends
with a leaf whose digest begins with 0 (content decides, so an edit does not
move the sections after it). A section's digest covers its leaves', the root
covers the sections'.

A fingerprint is the root, a colon, and the full leaf digests in order. Equal
roots mean equal texts, since the leaves hold every character. The likeness of
two fingerprints is the Dice share of their common leaves. ``differing_leaves``
and ``same_ends`` walk two trees branch by branch and locate an edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, let, table, with_key

# One leaf: up to 48 characters with the sentence or line end behind them.
LEAF = r"[^.!?\n]{0,48}[.!?\n]+ *|[^.!?\n]{1,48}"
DIGEST = 32  # hex digits of a leaf
ROWS_PER_BUCKET = 500
BUCKETS = 1 << 16  # one broadcast row each; beyond, buckets grow


def leaves(text: Column) -> Column:
    """Parts of a text, in order; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(LEAF), F.lit(0))


def fingerprint(text: Column, digits: int = DIGEST) -> Column:
    """root ':' leaf digests, each followed by a comma."""
    digests = F.array_join(F.transform(leaves(text), lambda x: F.concat(F.substring(F.md5(x.cast("binary")), 1, digits),
                                                                        F.lit(","))), "")
    return with_root(digests, digits)


def _cut(digests: Column, digits: int) -> Column:
    """Sections: the digests' string, cut after each that begins with 0."""
    return F.split(F.regexp_replace(digests, rf"\b(0[0-9a-f]{{{digits - 1}}},)", "$1|"), r"\|", -1)


def with_root(digests: Column, digits: int = DIGEST) -> Column:
    sections = F.transform(_cut(digests, digits), lambda s: F.md5(s.cast("binary")))
    return F.concat(F.substring(F.sha2(F.array_join(sections, "").cast("binary"), 256), 1, 32), F.lit(":"), digests)


def _set(fp: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.substring(fp, 34, 2147483647), ",", -1), ""))


def likeness(a: Column, b: Column) -> Column:
    """Dice share of common leaf digests; 1 for equal roots, so for two empty texts."""
    x, y = _set(a), _set(b)
    both = F.size(x) + F.size(y)
    same = F.substring(a, 1, 32) == F.substring(b, 1, 32)
    return F.when(same, 1.0).when(both == 0, 0.0).otherwise(2 * F.size(F.array_intersect(x, y)) / both)


def _shared(x: Column, y: Column) -> Column:
    """Number of elements that two arrays share at their heads."""
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    at = F.array_position(same, False).cast("int")
    return F.when(at == 0, F.least(F.size(x), F.size(y))).otherwise(at - 1)


def _unlike(ab: Column) -> Column:
    """(a, b) without the elements they share at both ends and, if as many are
    left of each, without those they share by position."""
    def ends(t: Column) -> Column:
        head = _shared(t["a"], t["b"])
        tail = F.least(_shared(F.reverse(t["a"]), F.reverse(t["b"])), F.least(F.size(t["a"]), F.size(t["b"])) - head)
        return F.struct(*[F.slice(t[c], head + 1, F.size(t[c]) - head - tail).alias(c) for c in "ab"])

    def middle(t: Column) -> Column:
        def other(c: str, d: str) -> Column:
            return F.filter(t[c], lambda x, i: F.get(t[d], i) != x)

        level = F.size(t["a"]) == F.size(t["b"])
        return F.struct(*[F.when(level, other(c, d)).otherwise(t[c]).alias(c) for c, d in ("ab", "ba")])

    return let(let(ab, ends), middle)


def differing_leaves(a: Column, b: Column, digits: int = DIGEST) -> Column:
    """Leaf digests of ``a`` at the places where the trees differ: first the
    sections are compared, then the leaves of those that differ."""
    def below(t: Column) -> Column:
        return F.struct(*[F.array_remove(F.split(F.array_join(t[c], ""), ",", -1), "").alias(c) for c in "ab"])

    tops = F.struct(*[_cut(F.substring(x, 34, 2147483647), digits).alias(c) for x, c in ((a, "a"), (b, "b"))])
    return let(let(_unlike(tops), below), _unlike)["a"]


def same_ends(a: Column, b: Column, digits: int = DIGEST) -> Column:
    """(head, tail): how many leaves two trees share at their start and, of the
    rest, at their end. Whole sections are compared first, then the leaves of the
    first and the last one that differ; what lies between is the edit."""
    def parts(x: Column) -> Column:
        return _cut(F.substring(x, 34, 2147483647), digits)

    def below(sections: Column) -> Column:
        return F.array_remove(F.split(F.array_join(sections, ""), ",", -1), "")

    def rest(t: Column, head: Column, c: str) -> Column:
        return F.slice(t[c], head + 1, F.size(t[c]) - head)

    def descend(t: Column) -> Column:
        head = _shared(t["a"], t["b"])
        return let(F.struct(F.size(below(F.slice(t["a"], F.lit(1), head))).alias("n"), rest(t, head, "a").alias("a"), rest(t, head, "b").alias("b")),
                   from_head)

    def from_head(t: Column) -> Column:
        tail = _shared(F.reverse(t["a"]), F.reverse(t["b"]))
        first = [below(F.slice(t[c], F.lit(1), F.lit(1))) for c in "ab"]
        last = [F.reverse(below(F.slice(t[c], F.greatest(F.size(t[c]) - tail, F.lit(1)), F.lit(1)))) for c in "ab"]
        # where one side is all shared, nothing is left to compare
        more = F.when(tail < F.least(F.size(t["a"]), F.size(t["b"])), _shared(*last)).otherwise(0)
        found = F.struct(_shared(*first).alias("head"), (F.size(below(F.slice(t["a"], F.size(t["a"]) - tail + 1, tail))) + more).alias("tail"),
                         F.least(F.size(below(t["a"])), F.size(below(t["b"]))).alias("most"))
        return let(found, lambda f: F.struct((t["n"] + f["head"]).cast("long").alias("head"),
                                             F.least(f["tail"], f["most"] - f["head"]).cast("long").alias("tail")))

    return let(F.struct(parts(a).alias("a"), parts(b).alias("b")), descend)


def _bucket(id_col: Column, cuts: list[int]) -> Column:
    """Number of ``cuts`` (sorted) that are at most the id, by binary search;
    -1 for a null id."""
    if not cuts:
        return F.when(id_col.isNull(), -1).otherwise(0)
    at = F.lit(cuts)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def step(lo: Column, size: Column) -> Column:
        up = lo + size
        return F.when((up <= len(cuts)) & (F.get(at, up - 1) <= id_col), up).otherwise(lo)

    return F.when(id_col.isNull(), -1).otherwise(F.aggregate(F.lit(steps), F.lit(0), step))


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(``_id``, row key, ``_text``, ``_fp``, ``_next_text``, ``_next_fp``): every row
    with the next one by descending id, after the last the first.

    Null ids follow all others; rows of one id are in the order of their row
    key. Rows are cut into buckets at quantiles of the id and the first row of
    each bucket is copied into the bucket before it, so one shuffle of the
    texts finds every neighbour and no task holds more than a bucket (all
    rows of one id share a bucket).
    """
    x = with_key(docs).select(*KEY, F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n = docs.count()
    buckets = max(1, min(BUCKETS, -(-n // rows_per_bucket)))
    cuts = None
    if buckets > 1:
        cuts = docs.agg(F.percentile_approx(id_col, [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
    bucket = _bucket(F.col("_id"), sorted(set(cuts or [])))
    nulls = docs.filter(F.col(id_col).isNull()).count()
    if nulls > rows_per_bucket:  # null ids, which are last, are cut by their row key
        cells = min(BUCKETS, -(-nulls // rows_per_bucket))
        cell = F.floor((F.col(KEY[0]).cast("double") / 2.0**64 + 0.5) * cells).cast("int")
        bucket = F.when(F.col("_id").isNull(), F.greatest(F.least(cell, F.lit(cells - 1)), F.lit(0)) - cells).otherwise(bucket)
    x = x.withColumn("_bucket", bucket)
    order = ["_id", *KEY]
    heads = x.groupBy("_bucket").agg(F.max(F.struct(*order)).alias("_head"))
    down = Window.orderBy(F.desc("_bucket"))
    heads = heads.select(*[F.col(f"_head.{k}").alias(k) for k in KEY], F.coalesce(
        F.lag("_bucket").over(down), F.min("_bucket").over(Window.partitionBy())).alias("_before"))
    x = x.join(F.broadcast(heads), list(KEY), "left")  # one row per bucket, BUCKETS + 1 at most
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guard"))
    guard = F.struct(F.col("_before").alias("b"), F.lit(True).alias("guard"))
    x = x.select(*order, "_text", F.inline(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, guard))))
    x = x.repartition("b").withColumn("_fp", fingerprint(F.col("_text")))
    line = Window.partitionBy("b").orderBy("guard", F.desc_nulls_last("_id"), *[F.desc(k) for k in KEY])
    x = x.select(*order, "_text", "_fp", "guard", F.lead("_text").over(line).alias("_next_text"),
                 F.lead("_fp").over(line).alias("_next_fp"))
    return x.filter("not guard").drop("guard")


def edited(text: Column, other: Column) -> Column:
    """The last half (rounded down) of the code points of ``text`` replaced by
    as many of ``other``'s first, or by all of them."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 9 over whole ``documents``: every text, its edited text and the next text;
    ``same_head`` and ``same_tail`` are the leaves before and behind the edit. Null texts are
    empty; repeated rows follow one another; an empty table gives no rows."""
    x = with_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    x = x.withColumn("_edited", edited(F.col("_text"), F.col("_next_text")))
    x = x.select(F.col("_id").alias("doc_id"), F.length("_text").cast("long").alias("n_chars"),
                 F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), F.col("_fp").alias("fingerprint"),
                 fingerprint(F.col("_edited")).alias("edited_fingerprint"), "_next_fp")
    pair = F.col("fingerprint"), F.col("edited_fingerprint")
    x = x.withColumns({"near_edited": likeness(*pair), "near_next": likeness(F.col("fingerprint"), F.col("_next_fp")),
                       "_ends": same_ends(*pair)}).drop("_next_fp")
    return x.withColumns({"same_head": F.col("_ends.head"), "same_tail": F.col("_ends.tail")}).drop("_ends")


def _sql_digests(text: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({text}, '{LEAF}'), "
            f"lambda x: md5(x)[1:{DIGEST}] || ','), '')")


def _sql_root(digests: str) -> str:
    return (rf"left(sha256(array_to_string(list_transform(string_split(regexp_replace({digests}, "
            rf"'\b(0[0-9a-f]{{{DIGEST - 1}}},)', '\1|', 'g'), '|'), lambda s: md5(s)), '')), 32) || ':' || {digests}")


def _sql_leaves(digests: str) -> str:
    return f"string_split({digests}, ',')[:-2]"


def _sql_set(digests: str) -> str:
    return f"list_distinct({_sql_leaves(digests)})"


def _sql_shared(x: str, y: str) -> str:
    same = f"list_transform(list_zip({x}, {y}), lambda p: p[1] IS NOT DISTINCT FROM p[2])"
    return f"coalesce(nullif(list_position({same}, false), 0) - 1, len({x}))"


# By a plain lead over all rows; the tree is built by the same definition.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM d
      WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substring(text, 1, (length(text) - length(text) // 2)::BIGINT)
        || substring(nxt, 1, (length(text) // 2)::BIGINT) AS edit FROM n),
g AS (SELECT *, {_sql_digests('text')} AS dt, {_sql_digests('edit')} AS de, {_sql_digests('nxt')} AS dn FROM e),
f AS (SELECT *, {_sql_root('dt')} AS ft, {_sql_root('de')} AS fe, {_sql_root('dn')} AS fn,
        {_sql_set('dt')} AS lt, {_sql_set('de')} AS le, {_sql_set('dn')} AS ln,
        {_sql_leaves('dt')} AS xt, {_sql_leaves('de')} AS xe FROM g),
h AS (SELECT *, {_sql_shared('xt', 'xe')} AS head, {_sql_shared('list_reverse(xt)', 'list_reverse(xe)')} AS tail FROM f)
SELECT doc_id, length(text) AS n_chars, sha256(edit) AS edited_sha256, ft AS fingerprint, fe AS edited_fingerprint,
  (CASE WHEN left(ft, 32) = left(fe, 32) THEN 1.0::DOUBLE WHEN len(lt) + len(le) = 0 THEN 0.0
        ELSE 2 * len(list_intersect(lt, le)) / (len(lt) + len(le)) END)::DOUBLE AS near_edited,
  (CASE WHEN left(ft, 32) = left(fn, 32) THEN 1.0::DOUBLE WHEN len(lt) + len(ln) = 0 THEN 0.0
        ELSE 2 * len(list_intersect(lt, ln)) / (len(lt) + len(ln)) END)::DOUBLE AS near_next,
  head::BIGINT AS same_head, least(tail, len(xt) - head, len(xe) - head)::BIGINT AS same_tail
FROM h
"""
