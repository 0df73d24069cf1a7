"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 2).

A fingerprint has 64 bits, cut into three segments of 22, 21 and 21 bits, each
padded with zeros to 23. The binary Golay code (23, 12) is perfect: every
23-bit word is at most 3 bits from exactly one codeword. A word whose nearest
codeword is 3 bits away has five more codewords at 4 bits; all six codeword
indices together are its *near* indices, the nearest its *home* index.

Guarantee. Two fingerprints with at most 2 differing bits have a segment i
without error whose cyclic successor j has at most 1 (pigeonhole over (2,0,0),
(1,1,0) and their rotations). If two words differ in one bit, the home index
of one is within 3 + 1 bits of the other, so it is among the other's near
indices. Hence the home key (i, segment i, home index of j) of the one meets a
near key (i, segment i, near index of j) of the other: no link is lost. The
join is then verified by the bit count.

Hot keys. A key with more than ``bucket`` distinct fingerprints is not joined.
Each fingerprint that has such a key is instead sent to itself and its 64
one-bit neighbours: two fingerprints at most 2 bits apart meet at a midpoint,
and all that meet there are within 2 bits of each other, so a star on the
smallest keeps every component. A midpoint has 65 members at most, so this
way needs no cap.

Equal fingerprints are one node throughout; copies are never paired.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, columns, rejoin, slices, stored, table, with_key
from .components import components

SHINGLE = 3
MAX_BITS = 2
BUCKET = 16
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)

_xxh = partial(xxhash.xxh64_intdigest, seed=42)


@lru_cache(1)
def _byte_bits() -> np.ndarray:
    """256 x 8: the bits of each byte value."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a UTF-8 text. ``bytes.lower`` and ``bytes.split``
    touch A-Z and the six ASCII blanks only, as the contract asks."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return _xxh(b" ".join(words))
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:n + i] for i in range(shingle)), strict=True))
    octets = np.fromiter(map(_xxh, grams), np.dtype("<u8"), n).view(np.uint8).reshape(n, 8)
    out = 0
    for b in range(8):
        ones = np.bincount(octets[:, b], minlength=256) @ _byte_bits()
        for i in np.flatnonzero(2 * ones > n):
            out |= 1 << (8 * b + int(i))
    return out


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``carry`` columns plus ``fp`` (signed 64 bits), one row per row."""
    x = docs.select(*carry, F.col(text_col).cast("binary").alias("_text"))

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in b.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(fps.view(np.int64))],
                                             names=[*carry, "fp"])

    fields = [x.schema[c] for c in carry]
    return x.mapInArrow(run, _schema(fields, ["fp"]))


def _schema(fields, longs):
    from pyspark.sql.types import LongType, StructField, StructType
    return StructType([*fields, *(StructField(n, LongType()) for n in longs)])


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


@lru_cache(1)
def _errors() -> np.ndarray:
    """2048 x 6: error words of weight at most 4 per syndrome, the lightest
    first; syndromes with one such word repeat it."""
    words = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)], np.int64)
    syn = _syndrome(words)
    out = np.full((2048, 6), -1, np.int64)
    for s, e in zip(syn.tolist(), words.tolist(), strict=True):  # combinations come by rising weight
        out[s, int((out[s] >= 0).sum())] = e
    return np.where(out < 0, out[:, :1], out)


def near_indices(words: np.ndarray) -> np.ndarray:
    """n x 6 codeword indices near 23-bit words; column 0 is the home index."""
    return (words[:, None] ^ _errors()[_syndrome(words)]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home keys (n x 3) and near keys (n x 3 x 6) of unsigned fingerprints."""
    seg = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    near = np.stack([(np.int64(i) << 34 | seg[i] << 12)[:, None] | near_indices(seg[(i + 1) % 3])
                     for i in range(3)], axis=1)
    return near[:, :, 0], near


def _keyed(fps: DataFrame) -> DataFrame:
    """(fp, key, home) rows: a near key each, flagged where it is a home key."""

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            _, near = golay_keys(fp.view(np.uint64))
            flat = near.reshape(len(fp), 18)
            home = np.zeros((len(fp), 18), bool)
            home[:, ::6] = True
            once = home.copy()  # repeats of the home index fill words with one near index
            for i in range(3):
                six = flat[:, 6 * i:6 * i + 6]
                once[:, 6 * i + 1:6 * i + 6] = six[:, 1:] != six[:, :1]
            rows = np.repeat(fp[:, None], 18, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(rows[once]), pa.array(flat[once]), pa.array(home[once])],
                                             names=["fp", "key", "home"])

    return fps.select("fp").mapInArrow(run, "fp long, key long, home boolean")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v) edges that connect exactly what links of at most 2 differing
    bits connect. ``distinct``: one row per fingerprint, column ``fp``."""
    keyed = stored(_keyed(distinct), "golay")
    home = keyed.filter("home").select("key", F.col("fp").alias("u"))
    sizes = home.groupBy("key").count()
    crowded = stored(sizes.filter(F.col("count") > bucket).select("key"), "crowded")
    # a key of one member with no other prober meets nobody but itself
    calm = home.join(crowded, "key", "left_anti")
    met = (calm.join(keyed.select("key", F.col("fp").alias("v")), "key")
           .filter((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS))
           .select("u", "v"))
    hot = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    spread = hot.select("fp", F.explode(flips).alias("_flip")).select(
        F.col("fp").bitwiseXOR(F.col("_flip")).alias("mid"), "fp")
    least = spread.groupBy("mid").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    stars = spread.join(least, "mid").filter("fp <> u").select("u", F.col("fp").alias("v"))
    return met.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    bucket: int = BUCKET, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``fp``, ``component_id`` and ``carry``.

    ``component_id`` is the smallest id reachable over links of at most two
    bits (null only if every id in the component is null). A null or empty
    text has fingerprint zero and is linked like any other; repeated rows and
    ids keep their rows. Extra columns are not looked at.
    """
    fps = stored(fingerprints(docs, [id_col, *carry], text_col, shingle), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min(id_col).alias("_least"))
    roots = components(links(nodes.select("fp"), bucket))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("_root"))
    classes = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = named.join(classes, "_root").select("fp", "component_id", F.col("_root").alias("_class"))
    return fps.join(named, "fp")


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 2 over whole ``documents``."""
    x = near_duplicates(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component: the smallest id (null ids last),
    among rows of one id the smallest row key. Null and empty texts are one component;
    rows equal in every column count once; an empty table passes; columns may have
    any name but the row key's."""
    x = near_duplicates(with_key(docs), carry=KEY)
    first = x.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("_f"))
    return rejoin(docs, first.select(*[F.col(f"_f.{k}").alias(k) for k in KEY])).select(columns(docs))
