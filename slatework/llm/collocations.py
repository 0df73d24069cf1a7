"""Phrase collocation mining by HAT-trie counting (operator 12).

Each task counts the word sequences of its texts in a HAT-trie (``hat_trie``) and
spills subtrees as sorted runs of (language, phrase, count). The runs are dealt to
prefix partitions (language, first word) and merged there by an aggregate; a
prefix is salted by the phrase, so a frequent first word is spread as well.

The texts are read twice. A phrase can reach ``least`` occurrences only if its
pairs of words do. The first reading counts the words and, beside them, the pairs
by a hash of 32 bits. The hashes with ``least`` occurrences and more become a
filter of 2^``FILTER_BITS`` bits, of one size at any input. The second reading
counts the phrases of 2 to 4 words whose pairs all pass it. Equal hashes only let
rare phrases through, which are then counted exactly like all others, so the
result does not depend on the filter.

Scores, the cuts' counts and the cover by longer phrases are joins and aggregates
on the merged counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, table
from .hat_trie import BITS, MASK, HatTrie, Words

LEAST = 30
TOP = 2000
LONGEST = 4
COVER = 80  # per cent of a phrase's occurrences that make a longer one its cover
SLOT_BITS = 32  # of a pair's hash
FILTER_BITS = 26
SALT = 64
LIMIT = 1_500_000  # entries a task's tries hold before they spill half
WORDS = 1 << 20  # distinct words a task holds before it spills all
BURST = 4096  # entries of a container
STEP = 1 << 19  # words counted at a time; ids so stay below 2^BITS
RUN_ROWS = 200_000  # rows of a run after which it is written
SLOT_ROWS = 2_000_000  # pair hashes a task holds before it writes them

# exact where products pass 64 bits
SCORE = "(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"

_BREAK = b" \xff "  # a byte that is in no UTF-8 text
_TABLE = bytes((b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b) for b in range(256))
_MULT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Counter:
    """Counts the sequences of ``lengths`` words of one task: with ``seen`` those whose
    pairs all pass it; without, the hashes of all pairs as well."""

    def __init__(self, lengths: tuple[int, ...], seen: np.ndarray | None, limit: int, words: int, burst: int) -> None:
        self.lengths, self.seen = lengths, seen
        self.limit, self.most_words = limit, words
        self.trie = {"burst": burst, "depth": min(2, max(1, max(lengths) - 1))}
        self.slots: list[tuple[np.ndarray, np.ndarray]] = []
        self.forget()

    def forget(self) -> None:
        self.words = Words(_BREAK.strip())
        self.hashes = np.zeros(1 << 12, np.uint64)
        self.hashed = 1
        self.tries: dict[str, HatTrie] = {}

    def _ids(self, tokens: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        n = len(self.words)
        if n > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        self.hashes[self.hashed:n] = np.fromiter(map(xxhash.xxh64_intdigest, self.words.order[self.hashed:]), np.uint64, n - self.hashed)
        self.hashed = n
        return ids

    def _pairs(self, lang: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where two words stand together in one piece, and their hashes."""
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        h = (self.hashes[ids[at]] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))) * _MULT
        h = ((h ^ (h >> np.uint64(29))) ^ self.hashes[ids[at + 1]]) * _MIX
        return at, h ^ (h >> np.uint64(32))

    def _note(self, hashes: np.ndarray) -> None:
        """Count pair hashes; merged when many are held."""
        self.slots.append(np.unique(hashes >> np.uint64(64 - SLOT_BITS), return_counts=True))
        if sum(len(x) for x, _ in self.slots) > SLOT_ROWS:
            self.slots = [self._merged()]

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        slots, counts = (np.concatenate(x) for x in zip(*self.slots))
        order = np.argsort(slots, kind="stable")
        slots, counts = slots[order], counts[order]
        start = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        return slots[start], np.add.reduceat(counts, start)

    def add(self, lang: str, texts: list[str]) -> Iterator[pa.RecordBatch]:
        """Count the texts, ``STEP`` words at a time; runs that have to go meanwhile."""
        joined = _BREAK.join([t.encode().translate(_TABLE) for t in texts])
        tokens = joined.replace(b"\n", _BREAK).split()
        for at in range(0, len(tokens), STEP):
            self._count(lang, self._ids(tokens[at:at + STEP + max(1, max(self.lengths) - 1)]))
            yield from self.runs()

    def _count(self, lang: str, ids: np.ndarray) -> None:
        """Count the sequences that start at the first ``STEP`` ids; id 0 parts two pieces."""
        at, hashes = self._pairs(lang, ids)
        passes = None
        if self.seen is None:
            self._note(hashes[at < STEP])
        else:
            slot = hashes >> np.uint64(64 - FILTER_BITS)
            passes = np.zeros(max(0, len(ids) - 1), bool)
            passes[at] = self.seen[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
        firsts, rests = [], []
        for n in self.lengths:
            if n == 1:
                good = ids > 0
            else:
                good = np.ones(max(0, len(ids) - n + 1), bool)
                for j in range(n - 1):
                    good &= passes[j:j + len(good)]
            at = np.flatnonzero(good[:STEP])
            # a single word is the rest of a sequence without a first word: one container for all
            first, lead = (np.zeros(len(at), np.int64), 0) if n == 1 else (ids[at], 1)
            rest = np.zeros(len(at), np.int64)
            for j in range(lead, n):
                rest |= ids[at + j] << (BITS * (2 + lead - j))
            firsts.append(first)
            rests.append(rest)
        first, rest = np.concatenate(firsts), np.concatenate(rests)
        if not len(first):
            return
        order = np.lexsort((rest, first)) if self.lengths != (1,) else np.argsort(rest)
        first, rest = first[order], rest[order]
        start = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])]))
        counts = np.diff(np.concatenate([start, [len(first)]])).tolist()
        first, rest = first[start], rest[start].tolist()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1, [len(first)]]).tolist()
        trie = self.tries.setdefault(lang, HatTrie(**self.trie))
        for word, a, b in zip(first[edges[:-1]].tolist(), edges, edges[1:]):
            trie.add(word, rest[a:b], counts[a:b])

    def runs(self, end: bool = False) -> Iterator[pa.RecordBatch]:
        """Sorted runs of what has to go: half of each trie if there are too many
        entries; all at the end or if there are too many words."""
        everything = end or len(self.words) > self.most_words
        if everything or sum(t.entries for t in self.tries.values()) > self.limit:
            names = np.array(self.words.order, object)
            names[0] = b""
            rank = np.empty(len(names), np.int64)
            rank[sorted(range(len(names)), key=self.words.order.__getitem__)] = np.arange(len(names))
            for lang, trie in self.tries.items():
                held, n = [], 0
                for first, rest, counts in trie.spill(0 if everything else trie.entries // 2):
                    held.append((np.full(len(rest), first), rest, counts))
                    n += len(rest)
                    if n >= RUN_ROWS:
                        yield self._run(lang, held, names, rank)
                        held, n = [], 0
                if held:
                    yield self._run(lang, held, names, rank)
        if everything and not end:
            self.forget()
        held = sum(len(x) for x, _ in self.slots)
        if held > SLOT_ROWS or end and held:
            slots, counts = self._merged()
            self.slots = []
            none = pa.nulls(len(slots), pa.string())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(slots.astype(np.int64)), pa.array(counts)],
                                             names=["lang", "phrase", "slot", "n"])

    def _run(self, lang: str, trees: list[tuple], names: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        first, rest, counts = (np.concatenate(c) for c in zip(*trees))
        columns = [first] + [rest >> (BITS * j) & MASK for j in (2, 1, 0)]
        if self.lengths == (1,):
            columns = columns[1:]
        columns = columns[:max(self.lengths)]
        order = np.lexsort([rank[c] for c in reversed(columns)])
        columns = [c[order] for c in columns]
        parts = [names[c].tolist() for c in columns]
        phrases = parts[0] if len(parts) == 1 else [b" ".join(p).rstrip(b" ") for p in zip(*parts)]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]).take(pa.array(np.zeros(len(order), np.int32))), pa.array(phrases, pa.binary()).cast(pa.string()),
             pa.nulls(len(order), pa.int64()), pa.array(counts[order])], names=["lang", "phrase", "slot", "n"])


def counted(texts: DataFrame, lengths: tuple[int, ...], seen: np.ndarray | None = None, limit: int = LIMIT, words: int = WORDS,
            burst: int = BURST) -> DataFrame:
    """(``lang``, ``phrase``, ``slot``, ``n``) of the sequences of ``lengths`` words in (``lang``, ``text``)
    rows. Without ``seen`` there are rows of pair hashes too, which have a ``slot`` and no
    phrase; with it, only sequences whose pairs all pass it are counted."""
    shared = None if seen is None else texts.sparkSession.sparkContext.broadcast(seen)

    def run(batches):
        counter = _Counter(lengths, None if shared is None else shared.value, limit, words, burst)
        for b in slices(batches, 1000):
            langs: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                langs.setdefault(lang, []).append(text)
            for lang, held in langs.items():
                yield from counter.add(lang, held)
        yield from counter.runs(end=True)

    runs = texts.select("lang", "text").mapInArrow(run, "lang string, phrase string, slot long, n long")
    salt = F.coalesce("slot", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    runs = runs.withColumns({"prefix": F.substring_index("phrase", " ", 1), "salt": salt}).repartition("lang", "prefix", "salt")
    return runs.groupBy("lang", "prefix", "salt", "phrase", "slot").agg(F.sum("n").alias("n")).drop("prefix", "salt")


def pair_filter(frequent: DataFrame) -> np.ndarray:
    """Bits of the slots of frequent pairs: 2^``FILTER_BITS`` bits whatever their number."""
    slot = F.shiftright("slot", SLOT_BITS - FILTER_BITS)
    maps = (frequent.groupBy(F.shiftright(slot, 15).alias("block"))
            .agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits")).collect())
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in maps:  # at most 2^(FILTER_BITS - 15) rows of 4 KB
        out[r.block << 12:(r.block << 12) + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, **bounds) -> tuple[DataFrame, DataFrame]:
    """(frequent, totals): (``lang``, ``phrase``, ``size``, ``n``) of all phrases of 1 to 4 words with
    ``n`` >= ``least``, and (``lang``, ``n``) with all word occurrences."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    often = F.col("n") >= least
    first = stored(counted(texts, (1,), **bounds).filter(often | F.col("phrase").isNotNull()), "words")
    words, pairs = first.filter("phrase IS NOT NULL"), first.filter("slot IS NOT NULL")
    more = stored(counted(texts, (2, 3, 4), pair_filter(pairs), **bounds).filter(often), "phrases")
    frequent = words.filter(often).unionByName(more)
    return (frequent.select("lang", "phrase", F.size(F.split("phrase", " ", -1)).alias("size"), "n"),
            words.groupBy("lang").agg(F.sum("n").alias("n")))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int | None = TOP,
                 **bounds) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's best phrases of 2
    to 4 words by the lowest-scoring cut, without those that a longer one covers.

    Null texts are empty, a null language is ``und``; repeated rows count as often
    as they stand; an empty table gives no rows; other columns are not read.
    """
    freq, totals = phrase_counts(docs, lang_col, text_col, least, **bounds)
    cand = freq.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)

    def piece(start: Column, length: Column) -> Column:
        return F.array_join(F.slice(F.col("_w"), start, length), " ")

    # a row per cut, its two parts looked up one after the other
    cuts = cand.withColumn("_w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"),
                       piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, out in (("left", "l"), ("right", "r")):
        cuts = cuts.join(freq.select("lang", F.col("phrase").alias(side), F.col("n").alias(out)), ["lang", side])
    best = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_m"))
    best = best.select("lang", "phrase", "a", "_m.l", "_m.r", "_m.score")

    # the longest count of a phrase that holds a candidate
    inner = cand.filter("size > 2").withColumn("_w", words)
    inner = inner.withColumn("len", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("len") + 1)))
    inner = inner.groupBy("lang", piece(F.col("at"), F.col("len")).alias("phrase")).agg(F.max("a").alias("_longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter("_longer IS NULL OR 100 * _longer < {0} * a".format(COVER))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 12 over whole ``documents``; nulls, repeats and an empty table as in ``collocations``."""
    return collocations(table(spark, sf_dir, "documents"))


def _sql(least: int, top: int) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    leads = ", ".join(f"lead(word, {j}) OVER s AS w{j}" for j in range(1, LONGEST))
    grams = "\nUNION ALL ".join(
        f"SELECT lang, {k} AS size, {' || '.join(['word', *[f"' ' || w{j}" for j in range(1, k)]])} AS phrase FROM v"
        + (f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "") for k in range(1, LONGEST + 1))
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
u AS (SELECT row_number() OVER () AS no, lang, string_split_regex(piece, '[\x20\x09]+') AS ws FROM p),
w AS (SELECT no, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM u),
v AS (SELECT lang, word, {leads} FROM w WHERE word <> '' WINDOW s AS (PARTITION BY no ORDER BY pos)),
g AS ({grams}),
f AS (SELECT lang, size, phrase, count(*)::BIGINT AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND n >= {least}),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, l.n AS l, r.n AS r, ((2000000::HUGEINT * k.a) // (l.n::HUGEINT + r.n))::BIGINT AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ')
             JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, ws, size, unnest(range(2, size)) AS len FROM c),
j AS (SELECT lang, a, ws, len, unnest(range(1, size - len + 2)) AS pos FROM i),
h AS (SELECT lang, array_to_string(ws[pos:pos + len - 1], ' ') AS phrase, max(a) AS longer FROM j GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVER} * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT q.lang, rank, phrase, a, l, r, t.n, score FROM q JOIN t USING (lang) WHERE rank <= {top}
"""


SQL = _sql(LEAST, TOP)
