import random
import re

from slatework.llm import decontam as C

from .data import AWKWARD, table


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_containment_equals_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([3, 5, 9, 14, 40, 120])))) for i in range(60)]
    docs = []
    for d in range(300):
        words = rnd.choices(vocab, k=rnd.choice([4, 30, 2000]))
        for _ in range(rnd.randint(0, 3)):
            part = rnd.choice(items)[1].split()
            cut = rnd.randint(int(len(part) * 0.6), len(part))  # around the threshold
            part = [w if rnd.random() > 0.02 else "zz" for w in part[:cut]]
            at = rnd.randint(0, len(words))
            words[at:at] = [w.upper() if rnd.random() < 0.2 else w + "," for w in part]
        docs.append((d, " ".join(words), "en", "s", 1))
    docs += [(1000 + i, t, "en", "s", 1) for i, t in items[:10]]  # the item is the whole text
    got = {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in C.contained(
        table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    own = {d[0]: shingles(d[1]) for d in docs}
    for i, t in items:
        s = shingles(t)
        for d, x in own.items():
            if 5 * len(s & x) >= 4 * len(s):
                want[d, i] = (len(s & x), len(s))
    assert got == want and len(want) > 60


def test_awkward(spark, tmp_path):
    docs = table(spark, AWKWARD, clash=True)
    items = spark.createDataFrame([(1, AWKWARD[0][1]), (1, AWKWARD[0][1]), (1, AWKWARD[3][1]), (2, None), (3, ""), (None, "word " * 9)],
                                  "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in C.contained(docs, items).collect()), key=repr)
    # equal rows count once; an id with two texts has a row for each
    assert got == sorted([(4, None), (5, 1), (6, 1), (9, 1), (9, 1), (None, 1)], key=repr)
    assert C.contained(docs.limit(0), items).count() == 0
    assert C.contained(docs, items.limit(0)).count() == 0
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = C.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 2, 3, 7, 8, None], key=repr)


def test_a_phrase_that_many_items_share_is_no_sketch(spark):
    """Rare shingles come first, and nothing is lost by it."""
    common = "one two three four five six seven eight nine ten"
    items = [(i, f"{common} own{i}a own{i}b own{i}c own{i}d own{i}e own{i}f own{i}g") for i in range(50)] + [(99, common)]
    df = spark.createDataFrame(items, "item_id long, text string")
    x = C.sketched(C.item_shingles(df, "item_id", "text")).collect()
    shared = {r.hash for r in x if sum(y.hash == r.hash for y in x) > 1}
    assert not [r for r in x if r.sketch and r.hash in shared and r._item != 99]
    assert {r._item for r in x if r.sketch} == {i for i, _ in items}
    docs = table(spark, [(i, "before " + t + " after", "en", "s", 1) for i, t in items[:10]] + [(70, common, "en", "s", 1)])
    got = {(r.doc_id, r.item_id) for r in C.contained(docs, df).collect()}
    assert got == {(i, i) for i in range(10)} | {(i, 99) for i in [*range(10), 70]}
