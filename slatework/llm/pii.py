"""Personal data by bootstrapped contextual extraction (operator 10).

1. Seeds: e-mail addresses, IP addresses, payment cards (Luhn) and phone
   numbers found by their form.
2. Occurrences: the seeds and, of any length, all other groups of digits joined
   by single blanks, dots, hyphens or brackets, and tokens that hold a digit or
   an @ (``CANDIDATE``). The form of an occurrence's surroundings is its lexical pattern: the two words before it, and
   the word before together with the word after (lower case, digits as 0).
3. The graph of patterns and instances (distinct texts) is scored in turns.
   A pattern's confidence for a kind is the share of its distinct instances
   that are of the kind, shrunk for patterns with few instances; an instance
   that is no seed gets the noisy-or of its confident patterns.
4. Occurrences of an instance whose score for a kind is high, standing in a
   confident pattern of that kind, are added as spans. Seeds always stay.

Texts are read in one pass; afterwards only occurrences and graph edges are
shuffled. A frequent pattern or instance is an aggregate and a join key, never
one task's list.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, let, stored, table, with_key

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. What is added changes no match: a possessive run
# with "not inside such a run" in front keeps long runs linear, and the nested
# atomic groups keep Java's stack flat on long repeats.
_LABELS = r"(?>(?>(?:\.[A-Za-z0-9-]++){1,100}){1,100})++"
PATTERNS = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++{_LABELS}",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?>(?>(?:[\x20-]?[0-9]){1,100}){1,100})++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
# Groups of digits (one that runs on into letters is no group); else a token with
# a digit or @, from its first character to its last.
_GROUP = r"[0-9]++(?![A-Za-z_%+@]|[.-]++[A-Za-z_%+@])"
_JOINED = rf"\(?{_GROUP}(?>(?>(?:(?:\)[\x20.-]?|[\x20.-]\(?|\(){_GROUP}){{1,100}}){{1,100}})++"
TOKEN = r"(?=[._%+@-]*+[A-Za-z0-9])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*+"
CANDIDATE = rf"(?<![A-Za-z0-9._%+@-])(?:{_JOINED}|{TOKEN})"

ROUNDS = 3
SHRINK = 3.0  # instances added to a pattern's total
CONFIDENT = 0.8
# the words of context that a pattern reads on either side, however long; each word is tried once
_BEFORE = r"(?<!\S)(?:\S++\s++)?\S++\s*+$"
_AFTER = r"^\s*+\S*+"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))
    rev = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(rev, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.rlike(m, F.lit(_IP))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text, left, right) of all matches, leftmost and not
    overlapping, in code points; left and right are the text around.

    The gaps of a split and the matches take turns, so a match starts at the
    sum of the lengths before it. The sums are taken over blocks of sqrt(n)
    lengths, which keeps long lists of numbers cheap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)

    def lengths(p: Column) -> Column:
        steps = F.transform(p["gaps"], lambda g, i: F.length(g) + F.coalesce(F.length(F.get(p["found"], i - 1)), F.lit(0)))
        return F.struct(p["found"].alias("found"), p["gaps"].alias("gaps"), steps.alias("steps"),
                        F.ceil(F.sqrt(F.size(steps))).cast("int").alias("block"))

    def spans(q: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(q["steps"]) / q["block"]).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.slice(q["steps"], b * q["block"] + 1, q["block"])))
        return let(sums, lambda s: let(F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))), lambda before: F.transform(
            q["found"], lambda m, i: span(q, before, m, i))))

    def span(q: Column, before: Column, m: Column, i: Column) -> Column:
        b = F.floor(i / q["block"]).cast("int")
        start = F.get(before, b) + total(F.slice(q["steps"], b * q["block"] + 1, i - b * q["block"] + 1))

        def around(*at: tuple[str, int]) -> Column:
            return F.concat(*[F.coalesce(F.get(q[c], i + k), F.lit("")) for c, k in at])

        left = around(("found", -2), ("gaps", -1), ("found", -1), ("gaps", 0))
        right = around(("gaps", 1), ("found", 1), ("gaps", 2))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"),
                        F.regexp_extract(left, _BEFORE, 0).alias("left"), F.regexp_extract(right, _AFTER, 0).alias("right"))

    return let(let(parts, lengths), spans)


def _as(kind: int):
    """Number the kind of a match."""
    return lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"),
                              m["text"].alias("text"), m["left"].alias("left"), m["right"].alias("right"))


def seeds(text: Column) -> Column:
    """Array of (start, kind number, end, text, left, right) of the base spans, sorted."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,text:string,left:string,right:string>>")
    signs = {"email": "@", "ip": ".", "phone": "+"}
    parts = []
    for k, kind in enumerate(KINDS):
        check = partial(_valid, kind)
        rows = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda m: check(m["text"])), _as(k))  # noqa: B023
        parts.append(F.when(F.contains(text, F.lit(signs[kind])), rows).otherwise(none) if kind in signs else rows)
    return F.array_sort(F.concat(*parts))


def tokens(text: Column, base: Column) -> Column:
    """Array like ``seeds`` (kind -1) of the candidates that touch no base span; where
    joined groups touch one, of their single tokens that do not."""
    def apart(m: Column, spans: Column) -> Column:
        return ~F.exists(spans, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))

    def split(both: Column) -> Column:
        free = F.filter(both["all"], lambda m: apart(m, base))
        hit = F.filter(both["all"], lambda m: ~apart(m, base))
        return F.concat(free, let(hit, lambda h: F.filter(both["single"], lambda m: ~apart(m, h) & apart(m, base))))

    single = F.when(F.size(base) > 0, matches(text, rf"(?<![A-Za-z0-9._%+@-]){TOKEN}"))
    single = F.coalesce(single, F.array().cast("array<struct<start:int,end:int,text:string,left:string,right:string>>"))
    return F.transform(let(F.struct(matches(text, CANDIDATE).alias("all"), single.alias("single")), split), _as(-1))


def _patterns(left: Column, right: Column) -> Column:
    """Hashes of the two lexical patterns around a span."""
    form = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    before = F.split(F.trim(form(left)), r"\s+", -1)
    one = F.element_at(before, -1)
    two = F.concat_ws(" ", F.get(before, F.size(before) - 2), one)
    after = F.get(F.split(F.ltrim(form(right)), r"\s+", 2), F.lit(0))
    return F.array(F.xxhash64(F.lit("before"), two), F.xxhash64(F.lit("around"), one, after))


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row key, ``_id``, ``_base``, ``_occ``): base spans, and all spans with the hashes
    of their text and patterns; one row per row. Null texts count as empty."""
    text = F.col("_text")
    x = docs.select(*KEY, F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    x = x.withColumn("_base", seeds(text)).withColumn("_free", tokens(text, F.col("_base")))
    occ = F.transform(F.concat("_base", "_free"), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.xxhash64(F.lower(s["text"])).alias("inst"), _patterns(s["left"], s["right"]).alias("pats")))
    return x.select(*KEY, "_id", F.transform("_base", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("_base"), occ.alias("_occ"))


def confident(occ: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Score the pattern-instance graph of (``inst``, ``kind``, ``pat``) rows.

    Returns (``pat``, ``kind``, ``conf``) of confident patterns and (``inst``,
    ``kind``) of instances found, none of them a seed.
    """
    edges = stored(occ.groupBy("pat", "inst").agg(F.max("kind").alias("kind")), "edges")
    totals = edges.groupBy("pat").agg(F.count(F.lit(1)).alias("_all"))
    known = edges.filter("kind >= 0").select("pat", "inst", "kind", F.lit(1.0).alias("score"))
    seeded = edges.filter("kind >= 0").select("inst").distinct()
    open_edges = stored(edges.select("pat", "inst").join(seeded, "inst", "left_anti"), "open-edges")
    scores = known
    for _ in range(rounds):
        hits = scores.groupBy("pat", "kind").agg(F.sum("score").alias("_hits"))
        pats = hits.join(totals, "pat").select("pat", "kind", (F.col("_hits") / (F.col("_all") + SHRINK)).alias("conf"))
        pats = stored(pats.filter(F.col("conf") >= CONFIDENT), "patterns")
        noisy = 1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))
        found = open_edges.join(pats, "pat").groupBy("inst", "kind").agg(noisy.alias("score"))
        best = found.groupBy("inst").agg(F.max(F.struct("score", -F.col("kind"))).alias("_b")).select(
            "inst", (-F.col("_b.col2")).alias("kind"), F.col("_b.score").alias("score")).filter(F.col("score") >= CONFIDENT)
        best = stored(best, "instances")
        scores = known.unionByName(open_edges.join(best, "inst").select("pat", "inst", "kind", "score"))
    return pats, best.select("inst", "kind")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(row key, ``_id``, ``base``, ``spans``) arrays of (start, kind number, end),
    sorted; one row per row of ``docs``. Rows equal in every column are alike."""
    x = stored(occurrences(with_key(docs), id_col, text_col), "occurrences")
    occ = x.select(*KEY, F.inline("_occ")).select(*KEY, "start", "kind", "end", "inst", F.explode("pats").alias("pat"))
    pats, found = confident(occ.select("inst", "kind", "pat"), rounds)
    added = (occ.filter("kind < 0").drop("kind").join(found, "inst").join(pats.select("pat", "kind"), ["pat", "kind"])
             .select(*KEY, "start", "kind", "end").distinct())
    added = added.groupBy(*KEY).agg(F.collect_list(F.struct("start", "kind", "end")).alias("_added"))
    x = x.join(added, list(KEY), "left")
    return x.select(*KEY, "_id", F.col("_base").alias("base"), F.when(F.col("_added").isNull(), F.col("_base")).otherwise(
        F.array_sort(F.concat("_base", "_added"))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 10 over whole ``documents``; the counts are those of the base spans. A row
    per row: null texts are empty and have no spans, null and repeated ids stay as they
    are, an empty table gives no rows; other columns are not read."""
    x = extract(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, F.lit(k)))).cast("long").alias(f"n_{kind}")
              for k, kind in enumerate(KINDS)]
    return x.select(F.col("_id").alias("doc_id"), *counts,
                    F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
