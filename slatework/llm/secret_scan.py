"""Secret scans by one combined automaton (operator 11).

All rules are compiled on the driver into one minimal deterministic automaton
(``automaton``; a few thousand states, fixed by the rules) and every text is read
by it once, byte by byte, for all rules together. Each task builds its rows from
the transition arrays once. Rows of Spark are independent, so there is no
shuffle, and memory is a batch of texts.

A rule is a pattern and the least length of its secret, which is what follows
``head`` (the whole match without one). Matches are the pattern's leftmost
longest ones; those that fall short are dropped and what they covered is not
tried again. The rules of a single class of signs state their length in the
pattern: a shorter run holds no other match.

The contract's three kinds come first. The others are the public forms of
well-known credentials; they add spans and change none of the first three.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .automaton import Scanner, Tables, compile_rules, rows
from .common import slices, table


class Rule(NamedTuple):
    kind: str
    pattern: str
    head: str = ""
    least: int = 0


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_KEY = r"[A-Z\x20]*PRIVATE\x20KEY-----"
BASE = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", _ASSIGN, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private_key", rf"-----BEGIN\x20{_KEY}[A-Za-z0-9+/=:,\x09-\x0D\x20]*-----END\x20{_KEY}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", r"gh[oprsu]_", 36),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", r"xox[abeoprs]-", 10),
    Rule("google", r"AIza[A-Za-z0-9_-]+", r"AIza", 35),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", r"[rs]k_live_", 16),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=32),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9+/_.~=-]+", r"(?i)bearer\x20+", 20),
    Rule("url_login", r"://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$&*-]+@", least=8),
)
RULES = BASE + ADDED

_SPANS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("start", "kind", "end")]))


class _Texts:
    """Scans texts by the rules; positions are code points."""

    def __init__(self, rules, compiled, heads: list[Tables | None]) -> None:
        self.rules, self.scanner = rules, Scanner(compiled)
        self.heads = [None if t is None else rows(t)[0] for t in heads]

    def secret_length(self, data: bytes, start: int, rule: int, end: int) -> int:
        row, at = self.heads[rule], start
        if row is None:
            return end - start
        head = start
        while at < end:
            row = row[data[at]]
            at += 1
            if row[257]:
                break
            if row[256]:
                head = at
        return end - head

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        data = (text or "").encode(errors="surrogatepass")
        found = [(s, r, e) for s, r, e in self.scanner.find(data) if self.secret_length(data, s, r, e) >= self.rules[r].least]
        if found and not data.isascii():
            place, chars, last = {}, 0, 0
            for at in sorted({p for s, _, e in found for p in (s, e)}):
                chars += len(data[last:at].decode(errors="surrogatepass"))
                place[at], last = chars, at
            found = [(place[s], r, place[e]) for s, r, e in found]
        return sorted(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_col`` and ``spans``, a sorted array of (start, kind, end): kind is the
    rule's number, positions are code points, the end is exclusive.

    One row per row of ``docs`` (repeated rows and ids repeat), null and empty
    texts have no span, other columns are not read.
    """
    compiled = compile_rules(tuple(r.pattern for r in rules))
    heads = [compile_rules((r.head,))[1][0] if r.head else None for r in rules]
    x = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches):
        texts = _Texts(rules, compiled, heads)
        for b in slices(batches):
            found = [texts.spans(t) for t in b.column(1).to_pylist()]
            spans = pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in f] for f in found],
                             pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "kind", "end")])))
            yield pa.RecordBatch.from_arrays([b.column(0), spans], names=[id_col, "spans"])

    return x.mapInArrow(run, StructType([x.schema[id_col], StructField("spans", _SPANS)]))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 11 over whole ``documents``; counts and digest are those of the base
    spans. Nulls, repeats and an empty table as in ``scan``."""
    x = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{r.kind}")  # noqa: B023
              for k, r in enumerate(BASE)]
    return x.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
