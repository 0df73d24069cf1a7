import math
import random

import numpy as np
import pytest

from slatework.llm import langid as L

from .data import AWKWARD, table


def all_segmentations(word, index, probs, k):
    """Sum over every segmentation, spelled out."""
    if not word:
        return 1.0
    total = 0.0
    for size in range(1, min(L.LONGEST, len(word)) + 1):
        p = probs[index[word[:size]], k] if word[:size] in index else (L.FLOOR if size == 1 else 0.0)
        if p:
            total += p * all_segmentations(word[size:], index, probs, k)
    return total


@pytest.fixture(scope="module")
def model():
    pieces = L.read_pieces()
    p = L.Pieces(pieces)
    probs = np.random.default_rng(0).random((p.n + 1, 2))
    probs[0] = 0
    return p, {x: i + 1 for i, x in enumerate(pieces)}, probs / probs.sum(axis=0)


def test_forward_sums_all_segmentations(model):
    p, index, probs = model
    words = L.words_of("The größte Überraschung ñandú x ☃ 漢字漢 informa")
    got = L.forward(p, probs, words)
    for i, w in enumerate(words):
        for k in (0, 1):
            assert math.isclose(got[i, k], math.log(all_segmentations(w, index, probs, k)), rel_tol=1e-9)


def test_expected_counts_are_posterior_sums(model):
    p, index, probs = model
    word, counts = "▁them", np.array([[2.0, 0.0]])
    got = L.expected(p, probs, [word], counts)[:, 0]

    def paths(rest, used, weight):
        if not rest:
            yield used, weight
        for size in range(1, min(L.LONGEST, len(rest)) + 1):
            if rest[:size] in index:
                i = index[rest[:size]]
                yield from paths(rest[size:], [*used, i], weight * probs[i, 0])
            elif size == 1:
                yield from paths(rest[1:], used, weight * L.FLOOR)
    want, total = np.zeros(len(got)), 0.0
    for used, weight in paths(word, [], 1.0):
        total += weight
        for i in used:
            want[i] += weight
    assert np.allclose(got, 2 * want / total)


def texts(n, seed=0):
    rnd = random.Random(seed)
    lang = {"en": "the and with that from here there which would not house river stone".split(),
            "de": "der die das und nicht mit eine für größer straße fluss stein haus".split(),
            "fr": "le la les une avec pour dans été maison rivière pierre qui mais".split()}
    out = []
    for i in range(n):
        k = rnd.choice(sorted(lang))
        out.append((i, " ".join(rnd.choices(lang[k], k=rnd.randint(3, 20))).capitalize() + ".", k, "s", 1))
    return out


def test_learns_and_predicts(spark):
    train, test = texts(300), texts(200, 1)
    model = L.fit(table(spark, train), per_lang=60)
    got = {r.doc_id: r for r in L.predict(table(spark, test, clash=True), model, ["doc_id"]).collect()}
    assert sum(got[r[0]].lang_pred == r[2] for r in test) >= 198
    assert all(0 < r.score <= 1 for r in got.values())
    assert model.langs == ["de", "en", "fr"] and np.allclose(model.probs.sum(axis=0), 1)


def test_sample_is_bounded(spark):
    got = L.sample(table(spark, texts(300) + [(1000, None, "en", "s", 1), (1001, "x", None, "s", 1)]), 20, "lang", "text")
    n = {}
    for r in got.collect():
        n[r._lang] = n.get(r._lang, 0) + 1
    assert set(n) == {"de", "en", "fr"} and max(n.values()) <= 20 and min(n.values()) >= 10


def test_awkward(spark):
    model = L.fit(table(spark, texts(60)), per_lang=30)
    docs = table(spark, [*AWKWARD, (70, "x" * 100_000, None, None, None), (71, "²", None, None, None)], clash=True)
    got = L.predict(docs, model, ["doc_id"]).collect()
    assert len(got) == len(AWKWARD) + 2
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1] == by[2] == by[3] == by[8] == by[71] == ("und", 0.0)
    assert by[5][0] == "en" and by[70][0] in model.langs
    assert L.predict(docs.limit(0), model, ["doc_id"]).count() == 0
    none = L.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in L.predict(docs, none, ["doc_id"]).collect()} == {("und", 0.0)}


def test_sample_of_copies_holds_every_text(spark):
    few = [f"Text number {i} of a language with many copies." for i in range(3)]
    rows = [(i, few[i % 3], "xx", "s", 1) for i in range(6000)] + texts(300)
    got = [r._text for r in L.sample(table(spark, rows), 20, "lang", "text").collect() if r._lang == "xx"]
    assert sorted(got) == few


def test_no_piece_of_letters_is_left_out():
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=L.VOCABULARY)
    want = {p for p in (m.id_to_piece(i).lower() for i in range(m.get_piece_size())) if p.replace(L.START, "", 1).isalpha()}
    assert set(L.read_pieces()) == want and max(map(len, want)) > 8


def test_long_words_are_scored_whole(model, monkeypatch):
    p, _, probs = model
    rnd = random.Random(3)
    words = ["▁" + "".join(rnd.choices("thequickbrownfüßñ漢", k=n)) for n in (1, 5, 17, 18, 33, 34, 60, 200)]
    rolled = L.forward(p, probs, words)
    monkeypatch.setattr(L, "RUN", 10**6)
    assert np.allclose(rolled[:7], L.forward(p, probs, words[:7]), rtol=1e-9)  # the last one passes the range of a double
    monkeypatch.undo()
    monkeypatch.setattr(L, "RUN", 0)
    assert np.allclose(rolled, L.forward(p, probs, words), rtol=1e-9)
    assert np.isfinite(L.forward(p, probs, ["▁" + "x" * 70_000])).all()
    monkeypatch.undo()
    assert L.stretches(["▁abc", "▁" + "y" * 40]) == ["▁abc", "▁" + "y" * 32, "▁" + "y" * 8]


def test_query_end_to_end(spark, tmp_path):
    import zlib
    rows = texts(240)
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    # a language that only held-out rows have is never learned
    rows = [(i, t, "xx" if i == held[0] else lang, "s", 1) for i, t, lang, *_ in rows]
    rows += [(5000, None, "en", "s", 1), (5001, "12 34 !", "en", "s", 1), (None, rows[0][1], "en", "s", 1), (5002, "", None, None, None)]
    table(spark, rows, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    out = L.query(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "und") for r in got.values())
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {5000, 5001, 5002}
    right = [got[i].lang_pred == lang for i, _, lang, *_ in rows if i in held and lang != "xx"]
    assert sum(right) / len(right) > 0.95
