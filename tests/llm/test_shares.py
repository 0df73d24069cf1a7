"""Sharding and mixing."""

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from slatework.llm import mixing as M
from slatework.llm import sharding as S

from .data import AWKWARD, table


def corpus(n, seed=0, words=12):
    rnd = random.Random(seed)
    return [(i, " ".join(["w"] * rnd.randint(0, words)), "en", rnd.choice(["hot", "hot", "b", "c", None]), 1) for i in range(n)]


def naive_shards(data, shards, seed, each=False):
    """{id: (shard, slot)}, or with ``each`` the sorted (id, shard, slot) of all rows."""
    import hashlib
    by = defaultdict(list)
    for r in data:
        crc = "null" if r[1] is None else zlib.crc32(r[1].encode())
        h = hashlib.md5(f"{seed}:{'null' if r[0] is None else r[0]}:{crc}".encode()).hexdigest()
        by["1" if r[3] is None else "0" + r[3]].append((h, r))
    line = [((2 * k + 1) / (2 * len(g)), s, h, r) for s, g in by.items() for k, (h, r) in enumerate(sorted(g, key=lambda x: x[0]))]
    line.sort(key=lambda x: x[:3])
    out, slot = [], Counter()
    for p, x in enumerate(line):
        s = p * shards // len(line)
        out.append((x[3][0], s, slot[s]))
        slot[s] += 1
    return sorted(out) if each else {i: (s, k) for i, s, k in out}


def test_shards_equal_brute_force(spark):
    data = corpus(5003)
    got = {r.doc_id: (r.shard, r.slot) for r in S.assign(table(spark, data)).collect()}
    assert got == naive_shards(data, S.SHARDS, S.SEED)
    src = {r[0]: r[3] for r in data}
    for source, n in Counter(src.values()).items():
        per = Counter(got[i][0] for i in src if src[i] == source)
        assert max(per.values()) - min(per[s] for s in range(40)) <= 2 + 2 * (n < 40)


def test_shards_awkward(spark):
    docs = table(spark, AWKWARD, clash=True)
    got = S.assign(docs, shards=4).collect()
    assert len(got) == len(AWKWARD)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {len(v) for v in slots.values()} <= {3, 4}
    long = next(r for r in got if r.doc_id == 4)
    assert (long.size, long.text_crc32) == (150_016, zlib.crc32(b"word " * 30_000))
    none = next(r for r in got if r.doc_id == 2)
    assert (none.size, none.text_crc32) == (16, None)
    assert S.assign(docs.limit(0)).count() == 0
    out = S.stage(spark, docs, "")
    assert out.count() == len(AWKWARD) and out.columns.count("shard") == 1
    assert sorted(r.text or "" for r in out.collect()) == sorted(r[1] or "" for r in AWKWARD)


def naive_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, rest = {}, sum(sizes.values())
    free = set(names)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 3 * sizes[s] for s in over}
        rest -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


def test_targets_and_taken(spark):
    data = corpus(4000, words=60) + [(10_000 + i, "one two three", "en", "tiny", 1) for i in range(3)] + [(20_000, "", "en", "none", 0)]
    got = M.mix(table(spark, data)).collect()
    src = {r[0]: r[3] for r in data}
    sizes = Counter()
    for r in data:
        sizes[r[3]] += len(r[1].split())
    want = naive_targets(sizes)
    taken = Counter()
    for r in got:
        s = src[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    block = min(M.BLOCK, sum(sizes.values()) // M.FINEST) or 1
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * block, (s, taken[s], t)
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix(table(spark, data[::-1]).repartition(5)).collect()))


def test_quotas_are_sainte_lague_at_every_shard(spark):
    sizes = {"a": 9_000, "b": 5_000, "c": 2_500, "d": 40, "e": 0}
    t = M.targets(spark.createDataFrame([("0" + s, n) for s, n in sizes.items()], "_src string, source_size long"))
    shares = {r._src: r.target for r in t.collect()}
    rows = M.quotas(t, shards=5, block=16).collect()
    block = rows[0].block
    seq = sorted((-v / (2 * k + 1), s, k) for s, v in shares.items() if v for k in range(int(v / block) + 30))
    houses = [sum(sizes.values()) // block * (j + 1) // 5 for j in range(5)]
    for r in rows:
        assert r.seats == min(sum(1 for x in seq[:houses[r.shard]] if x[1] == r._src), 3 * r.blocks)
        assert r.quota >= 0


def test_mix_awkward(spark):
    docs = table(spark, AWKWARD, clash=True)
    got = M.mix(docs).collect()
    assert len(got) == len(AWKWARD)
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    assert M.mix(docs.limit(0)).count() == 0
    empty = table(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)])
    assert [(r.taken, r.target) for r in M.mix(empty).collect()] == [(0, 0.0)] * 2
    out = M.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.text for r in out.collect()} <= {r[1] for r in AWKWARD}
    assert M.stage(spark, docs.limit(0), "").count() == 0


def test_word_counts(spark):
    import re
    texts = ["", " ", "a", " a b  c\x0b\x0cd\r\n", "\x01 \x1f", "é " * 5000, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(M.words(F.col("text"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
