"""Line dedup and substring dedup."""

import random

from pyspark.sql import functions as F

from slatework.llm import line_dedup as L
from slatework.llm import substring_dedup as S
from slatework.llm.common import with_key

from .data import AWKWARD, table


def naive_lines(docs):
    """{id: deleted line numbers}: every line against all earlier ones."""
    seen, gone = set(), {}
    for d, text in sorted(docs.items()):
        gone[d] = set()
        for i, x in enumerate(text.split("\n")):
            if x.strip(" "):
                if x.strip(" ") in seen:
                    gone[d].add(i)
                seen.add(x.strip(" "))
    return gone


def test_repeated_runs_equal_brute_force(spark):
    rnd = random.Random(4)
    pool = [f"line {i}" for i in range(12)]
    runs = [[f"run {r} {i}" for i in range(rnd.randint(2, 9))] for r in range(6)]
    docs = {}
    for d in range(120):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            lines += rnd.choice(runs) if rnd.random() < 0.5 else rnd.choices([*pool, "", f"own {d}", "same"], k=3)
        docs[d] = "\n".join(lines)
    got = L.dedup_lines(table(spark, [(d, t, "en", "s", 1) for d, t in docs.items()])).collect()
    want = naive_lines(docs)
    assert {r.doc_id: set(r.removed) for r in got} == want
    for r in got:
        kept = [x for i, x in enumerate(docs[r.doc_id].split("\n")) if i not in want[r.doc_id]]
        assert r.text == "\n".join(kept) and r.n_removed == len(want[r.doc_id])


def naive_selected(h, w):
    out = []
    for s in range(max(1, len(h) - w + 1)):
        run = h[s:s + w]
        p = s + max(i for i, x in enumerate(run) if x == min(run))
        out += [p] if p not in out else []
    return out


def test_window_minima(spark):
    rnd = random.Random(6)
    rows = [([rnd.randint(0, 9) for _ in range(rnd.randint(1, 30))],) for _ in range(100)]
    for w in (1, 2, 4):
        got = spark.createDataFrame(rows, "h array<long>").select("h", L.selected(F.col("h"), w).alias("p")).collect()
        assert all(r.p == naive_selected(r.h, w) for r in got)


def test_a_run_is_extended_both_ways_from_its_fingerprints(spark):
    """Runs of w lines and more go as far as they reach before single lines are looked at."""
    run = [f"r{i}" for i in range(50)]
    docs = [(1, "\n".join(["a", *run, "b"]), "en", "s", 1), (2, "\n".join(["c", *run[:30], "NEW", *run[30:], "d"]), "en", "s", 1),
            (3, "\n".join(["x", *run[10:14], "y"]), "en", "s", 1), (4, "\n".join(["p", "q"] * 6), "en", "s", 1)]
    seq = L.line_sequences(with_key(table(spark, docs)), "doc_id", "text")
    key = {tuple(r[:2]): r._id for r in seq.collect()}
    got = {key[tuple(r[:2])]: sorted(r._gone) for r in L.runs(seq).collect()}
    assert got == {2: [*range(1, 31), *range(32, 52)], 3: [1, 2, 3, 4], 4: list(range(2, 12))}


def test_single_lines_go_too(spark):
    run = [f"r{i}" for i in range(50)]
    docs = [(1, "\n".join(["a", *run, "b"]), "en", "s", 1), (2, "\n".join(["c", *run[:30], "NEW", *run[30:], "r7", "d"]), "en", "s", 1),
            (3, "r9", "en", "s", 1), (4, "z\n r9 \n\nr3\nz", "en", "s", 1)]
    got = {r.doc_id: r.text for r in L.dedup_lines(table(spark, docs)).collect()}
    assert got == {1: docs[0][1], 2: "c\nNEW\nd", 3: "", 4: "z\n"}


def test_lines_awkward(spark):
    docs = table(spark, AWKWARD, clash=True)
    got = L.dedup_lines(docs).collect()
    assert len(got) == len(AWKWARD)
    texts = sorted(((r.doc_id, r.text and r.text[:5]) for r in got), key=repr)
    # id 5 is the first to hold A (both equal rows keep it), id 6 the first to hold B
    assert texts == sorted([(5, "The q"), (5, "The q"), (9, ""), (9, ""), (None, ""), (None, None), (1, ""), (2, None),
                            (3, "   \n\t"), (4, "word "), (6, "Entir"), (7, "x"), (8, "$$$ 1")], key=repr)
    assert L.dedup_lines(docs.limit(0)).count() == 0


def naive_units(docs):
    seen, out = set(), {}
    for d, t in sorted(docs.items()):
        out[d] = []
        for s, e, u in S.units(t):
            if u in seen:
                out[d].append((s, e))
            seen.add(u)
    return out


def test_units_cover_and_hold_whole_sentences():
    t = "Short one. This is a sentence of eight words here. Tiny. Again there are eight words in this one!\nnew line of five words\n"
    got = S.units(t)
    assert [t[s:e] for s, e, _ in got] == ["Short one. ", "This is a sentence of eight words here. ", "Tiny. ",
                                           "Again there are eight words in this one!\n"]
    # a short sentence counts with the longer one before it
    other = S.units("Tiny. Other words are in this longer sentence before it. Tiny.")
    assert not {d for _, _, d in got} & {d for _, _, d in other}
    assert [(s, e) for s, e, _ in S.units("One two. Three four. Five six. Seven eight.")] == [(0, 43)]


def test_later_units_equal_brute_force(spark):
    rnd = random.Random(6)
    pool = [" ".join(rnd.choices("abcdefghijklm", k=rnd.randint(4, 14))).capitalize() + rnd.choice([". ", "! ", ".\n"]) for _ in range(60)]
    docs = {d: "".join(rnd.choices(pool, k=rnd.randint(0, 12))) + f"Füller {d} 😀 " * rnd.randint(0, 9) for d in range(200)}
    got = {r.doc_id: r for r in S.dedup(table(spark, [(d, t, "en", "s", 1) for d, t in docs.items()])).collect()}
    for d, gone in naive_units(docs).items():
        assert [(x.start, x.end) for x in got[d].removed] == gone
        text = "".join(c for i, c in enumerate(docs[d]) if not any(s <= i < e for s, e in gone))
        assert got[d].text == text


def test_passage_in_the_middle_of_lines_is_caught(spark):
    passage = " ".join(f"Here word{i} goes on with many more words than eight in it." for i in range(6))
    docs = [(1, f"Head one. {passage} Tail one.", "en", "s", 1), (2, f"Another head that stands before it, and more. {passage} End.", "en", "s", 1),
            (3, "A clean text that nobody else has, with its own words only.", "en", "s", 1)]
    got = {r.doc_id: r for r in S.dedup(table(spark, docs)).collect()}
    assert not got[1].removed and not got[3].removed
    assert sum(x.end - x.start for x in got[2].removed) >= len(passage) - 2


def test_units_awkward(spark):
    docs = table(spark, AWKWARD, clash=True)
    got = sorted(((r.doc_id, r.text and r.text[:5]) for r in S.dedup(docs).collect()), key=repr)
    assert got == sorted([(5, "The q"), (5, "The q"), (9, ""), (9, ""), (None, ""), (None, None), (1, ""), (2, None),
                          (3, "   \n\t"), (4, "word "), (6, "Entir"), (7, "x"), (8, "$$$ 1")], key=repr)
    assert S.dedup(docs.limit(0)).count() == 0


def test_passages_of_short_lines_and_sentences_go(spark):
    lines = "".join(f"a line of word{i} and more\n" for i in range(10))
    sentences = " ".join(f"Now comes short sentence number{i} here." for i in range(10))
    copy = "one two three\nfour five\n"
    heads = [f"This differing sentence number {i} has more than eight words. " for i in range(4)]
    docs = [(1, heads[0] + "\nIn between.\n" + lines + "\n" + heads[1], "en", "s", 1), (2, heads[2] + "\n" + lines + "The end.", "en", "s", 1),
            (3, heads[3] + sentences, "en", "s", 1), (4, "Quite another long sentence stands before the short ones. " + sentences, "en", "s", 1),
            (5, copy, "en", "s", 1), (6, copy, "en", "s", 1)]
    got = {r.doc_id: r for r in S.dedup(table(spark, docs)).collect()}
    assert not got[1].removed and not got[3].removed and not got[5].removed
    # but for the last line, which other short text follows
    assert got[2].text == heads[2] + "\na line of word9 and more\nThe end."
    assert got[4].text == "Quite another long sentence stands before the short ones. "
    assert got[6].text == ""
