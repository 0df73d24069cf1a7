import random

import numpy as np

from slatework.llm import toxicity as T

from .data import AWKWARD, table


def corpus(n=600, seed=2):
    rnd = random.Random(seed)
    plain = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    data, labels = [], []
    for i in range(n):
        words = rnd.choices(plain, k=rnd.randint(5, 80))
        toxic = i % 6 == 0
        if toxic:
            words += rnd.choices(["idiot", "scum", "trash"], k=3)
        low = i % 5 == 0
        if low:
            words += ["lorem", "spam"]
        rnd.shuffle(words)
        data.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1 - int(low), int(toxic)))
    return data, labels


def test_chain_finds_toxic_texts_and_leaves_clean_ones(spark):
    data, labels = corpus()
    docs = table(spark, data, clash=True)
    y = spark.createDataFrame([x for x in labels if x[0] % 2 == 0], "doc_id long, quality int, toxic int")
    chain = T.fit(docs, y)
    assert list(chain.models) == ["low_quality", "toxic"]
    # the second model has one feature more: the probability of the first
    assert chain.models["toxic"].numFeatures == chain.models["low_quality"].numFeatures + 1
    got = {r._row.doc_id: r for r in T.classify(docs, chain).collect()}
    assert len(got) == len(data)
    truth = {i: t for i, _, t in labels}
    assert sum(bool(truth[i]) != got[i].toxic for i in got) <= 0.02 * len(data)
    assert all(0 <= got[i].p_toxic <= 1 and 0 <= got[i].p_low_quality <= 1 for i in got)


def test_awkward(spark, tmp_path):
    data, labels = corpus(200)
    y = spark.createDataFrame(labels + [(0, 1, 1), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    chain = T.fit(table(spark, data + AWKWARD), y)
    docs = table(spark, AWKWARD, clash=True)
    out = T.classify(docs, chain)
    assert out.count() == len(AWKWARD)
    assert not any(r.toxic for r in out.collect())
    assert T.classify(docs.limit(0), chain).count() == 0
    none = T.fit(docs, y.limit(0))
    assert {r.p_toxic for r in T.classify(docs, none).collect()} == {0.0}
    y.write.parquet(str(tmp_path / "labels.parquet"))
    assert T.stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_sample_is_bounded(spark):
    data, labels = corpus(300)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert T.labelled(table(spark, data), y, T.CATEGORIES, 50, "doc_id", "text").count() == 50


def newton(x, y, reg=0.01):
    """Regularised logistic regression on scaled features, by Newton's method."""
    std = x.std(axis=0, ddof=1)
    keep = std > 0
    z = np.column_stack([x[:, keep] / std[keep], np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(keep.sum(), reg), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (p - y) / len(y) + penalty * w
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z / len(y) + np.diag(penalty), grad)
    out = np.zeros(x.shape[1] + 1)
    out[:-1][keep], out[-1] = w[:-1] / std[keep], w[-1]
    return out


def apply(w, x):
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))


def test_chain_equals_one_by_hand(spark):
    """Out-of-fold probabilities, the chain and its threshold, computed anew outside Spark."""
    data, labels = corpus(400, 5)
    docs = table(spark, data)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = T.fit(docs, y)
    words = chain.counter.vocabulary
    rows = T.labelled(docs, y, T.CATEGORIES, T.SAMPLE, "doc_id", "text").collect()
    x = np.array([[float(w in set(r._words)) for w in words] for r in rows])
    fold = np.array([r._fold for r in rows])
    truth = {i: (float(1 - q), float(t)) for i, q, t in labels}
    assert all((r.y_low_quality, r.y_toxic) == truth[r._id] for r in rows)
    whole = {}
    held_x, full_x = x, x
    for c in T.CATEGORIES:
        target = np.array([r[f"y_{c}"] for r in rows])
        held = np.zeros(len(rows))
        for k in range(T.FOLDS):
            held[fold == k] = apply(newton(held_x[fold != k], target[fold != k]), held_x[fold == k])
        w = newton(held_x, target)
        whole[c] = apply(w, full_x)
        held_x, full_x = np.column_stack([held_x, held]), np.column_stack([full_x, whole[c]])
    got = {r._row.doc_id: r for r in T.classify(docs, chain).collect()}
    for c in T.CATEGORIES:
        assert np.abs(np.array([got[r._id][f"p_{c}"] for r in rows]) - whole[c]).max() < 0.02
    f1 = {}
    for t in range(5, 46):
        said = held >= t / 50
        if (hit := (target * said).sum()):
            f1[t] = 2 * hit / (said.sum() + target.sum())
    assert f1[round(chain.threshold * 50)] >= max(f1.values()) - 0.01


def test_repeated_ids_are_learned_alike(spark):
    data, labels = corpus(120)
    twice = data + [(i, "other words entirely", "en", "s", 1) for i, *_ in data[:60]]
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = (sorted((r._id, r._words) for r in T.labelled(table(spark, rows).repartition(n), y, T.CATEGORIES, 50, "doc_id", "text").collect())
            for rows, n in ((twice, 3), (twice[::-1], 7)))
    assert a == b and len(a) == 50
