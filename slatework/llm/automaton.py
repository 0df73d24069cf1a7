"""One deterministic byte automaton for many regexes.

``compile_rules`` parses each rule into a nondeterministic automaton, makes the
union deterministic by subset construction over classes of bytes that no rule
tells apart, and minimises it by partition refinement. The result is a pair of
transition arrays:

* ``starts``: all rules reversed, open at the right end. One pass over the bytes
  from last to first gives, at every byte, the rules that have a match starting
  there.
* ``ends``: each rule forward, closed at its start. It is run only from a start
  that the pass has found, to the longest match.

Together they give each rule's leftmost longest matches that do not overlap.

Patterns: literals, ``\\xHH`` and escaped signs, classes with ranges (ASCII, not
negated), groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``. ``(?i)`` in front
folds the case of ASCII letters outside classes. A pattern that matches nothing
(the empty string) is refused.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

MOST_STATES = 20_000


class Tables(NamedTuple):
    """``next[state, byte class]``, byte -> class, mask of rules per state; state 0 is the start."""

    next: np.ndarray
    byte_class: np.ndarray
    accept: np.ndarray


class _Nfa:
    """Fragments are (start, end) states; ``moves`` holds (from, byte set, to)."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def one(self, chars: frozenset[int]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.moves[a].append((chars, b))
        return a, b

    def build(self, tree, back: bool) -> tuple[int, int]:
        kind = tree[0]
        if kind == "set":
            return self.one(tree[1])
        a, b = self.state(), self.state()
        if kind == "or":
            for part in tree[1]:
                s, e = self.build(part, back)
                self.free[a].append(s)
                self.free[e].append(b)
        elif kind == "then":
            at = a
            for part in reversed(tree[1]) if back else tree[1]:
                s, e = self.build(part, back)
                self.free[at].append(s)
                at = e
            self.free[at].append(b)
        else:  # ("times", part, least, endless or optional)
            at = a
            for _ in range(tree[2]):
                s, e = self.build(tree[1], back)
                self.free[at].append(s)
                at = e
            self.free[at].append(b)
            if tree[3]:
                s, e = self.build(tree[1], back)
                self.free[at].append(s)
                self.free[e].append(b)
                if tree[3] == "endless":
                    self.free[e].append(s)
        return a, b

    def closure(self, start: int) -> int:
        """The states reachable without a byte, as a bit mask."""
        seen, todo = 1 << start, [start]
        while todo:
            for t in self.free[todo.pop()]:
                if not seen >> t & 1:
                    seen |= 1 << t
                    todo.append(t)
        return seen


def parse(pattern: str):
    """Tree of a pattern: sets, ``then``, ``or`` and ``times`` nodes."""
    fold = pattern.startswith("(?i)")
    text, at = pattern[4 * fold:], 0

    def fail(why: str):
        raise ValueError(f"{why} at {at} in {pattern!r}")

    def char() -> int:
        nonlocal at
        c = text[at]
        at += 1
        if c == "\\":
            c = text[at]
            at += 1
            if c == "x":
                at += 2
                return int(text[at - 2:at], 16)
            if c.isalnum():
                fail("unknown escape")
        if ord(c) > 127:
            fail("not ASCII")
        return ord(c)

    def cls() -> frozenset[int]:
        nonlocal at
        found: set[int] = set()
        if text[at] == "^":
            fail("negated class")
        while text[at] != "]":
            lo = hi = char()
            if text[at] == "-" and text[at + 1] != "]":
                at += 1
                hi = char()
            found |= set(range(lo, hi + 1))
        at += 1
        return frozenset(found)

    def atom():
        nonlocal at
        if text[at] == "(":
            at += 1
            tree = either()
            if at >= len(text) or text[at] != ")":
                fail("open group")
            at += 1
            return tree
        if text[at] == "[":
            at += 1
            return "set", cls()
        if text[at] in "*+?{.^$":
            fail("unsupported sign")
        c = char()
        both = {c, ord(chr(c).swapcase())} if fold and chr(c).isalpha() else {c}
        return "set", frozenset(both)

    def several():
        nonlocal at
        parts = []
        while at < len(text) and text[at] not in "|)":
            tree = atom()
            while at < len(text) and text[at] in "?*+{":
                c = text[at]
                at += 1
                if c == "{":
                    end = text.index("}", at)
                    least, comma, most = text[at:end].partition(",")
                    if most:
                        fail("upper bound")
                    at = end + 1
                    tree = ("times", tree, int(least), "endless" if comma else "")
                else:
                    tree = ("times", tree, int(c == "+"), "optional" if c == "?" else "endless")
            parts.append(tree)
        return "then", parts

    def either():
        nonlocal at
        parts = [several()]
        while at < len(text) and text[at] == "|":
            at += 1
            parts.append(several())
        return parts[0] if len(parts) == 1 else ("or", parts)

    tree = either()
    if at < len(text):
        fail("closing bracket")
    return tree


def _byte_classes(nfa: _Nfa) -> tuple[np.ndarray, list[int]]:
    """Bytes that every move treats alike share a class; one byte of each class."""
    sets = sorted({chars for m in nfa.moves for chars, _ in m}, key=sorted)
    marks = np.array([[b in s for s in sets] for b in range(256)], bool).reshape(256, len(sets))
    _, first, inverse = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    return inverse.reshape(-1).astype(np.uint16), first.tolist()


def _bits(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def _determine(nfa: _Nfa, start: int, accept: dict[int, int]) -> Tables:
    """Subset construction on sets held as bit masks, then Moore's partition refinement."""
    classes, sample = _byte_classes(nfa)
    reach = [nfa.closure(s) for s in range(len(nfa.free))]
    steps = []  # per state the (class, reached set) of its moves
    for moves in nfa.moves:
        steps.append([(c, reach[t]) for chars, t in moves for c, b in enumerate(sample) if b in chars])
    moving = sum(1 << s for s, found in enumerate(steps) if found)
    ending = sum(1 << s for s in accept)
    number, todo, rows, marks = {start: 0}, [start], [], []
    for states in todo:
        marks.append(sum(1 << r for r in {accept[s] for s in _bits(states & ending)}))
        to = [0] * len(sample)
        for s in _bits(states & moving):
            for c, found in steps[s]:
                to[c] |= found
        for t in to:
            if t not in number:
                if len(number) >= MOST_STATES:
                    raise ValueError(f"the rules need over {MOST_STATES} states")
                number[t] = len(number)
                todo.append(t)
        rows.append([number[t] for t in to])
    nxt, mark = np.array(rows), np.array(marks, np.int64)
    part, n = np.unique(mark, return_inverse=True)[1].reshape(-1), 0
    while part.max() + 1 != n:
        n = part.max() + 1
        part = np.unique(np.column_stack([part, part[nxt]]), axis=0, return_inverse=True)[1].reshape(-1)
    # the start's block first, the others in order of their number
    order = np.concatenate([[part[0]], np.delete(np.arange(n), part[0])])
    place = np.argsort(order)
    first = np.unique(part, return_index=True)[1][order]
    return Tables(place[part[nxt[first]]].astype(np.int32), classes, mark[first])


@lru_cache(maxsize=16)
def compile_rules(patterns: tuple[str, ...]) -> tuple[Tables, tuple[Tables, ...]]:
    """(starts of all patterns, ends of each)."""
    if len(patterns) > 62:
        raise ValueError("at most 62 rules in one automaton")
    trees = [parse(p) for p in patterns]
    nfa, accept = _Nfa(), {}
    root = nfa.state()
    nfa.moves[root].append((frozenset(range(256)), root))
    for i, tree in enumerate(trees):
        a, b = nfa.build(tree, back=True)
        if nfa.closure(a) >> b & 1:
            raise ValueError(f"{patterns[i]!r} matches the empty string")
        nfa.free[root].append(a)
        accept[b] = i
    starts = _determine(nfa, nfa.closure(root), accept)
    ends = []
    for tree in trees:
        one = _Nfa()
        a, b = one.build(tree, back=False)
        ends.append(_determine(one, one.closure(a), {b: 0}))
    return starts, tuple(ends)


def rows(tables: Tables) -> list:
    """The automaton as linked rows: ``row[byte]`` is the next row, ``row[256]`` the
    accept mask, ``row[257]`` whether no match can come any more."""
    out: list[list] = [[] for _ in range(len(tables.next))]
    dead = (tables.next == np.arange(len(tables.next))[:, None]).all(1) & (tables.accept == 0)
    for row, to, mark, end in zip(out, tables.next[:, tables.byte_class].tolist(), tables.accept.tolist(), dead.tolist(), strict=True):
        row.extend([out[t] for t in to])
        row += [mark, end]
    return out


class Scanner:
    """Finds the matches of all rules in a byte string; built once per task."""

    def __init__(self, compiled: tuple[Tables, tuple[Tables, ...]]) -> None:
        self.first = rows(compiled[0])[0]
        self.ends = [rows(t)[0] for t in compiled[1]]

    def longest(self, data: bytes, start: int, rule: int) -> int:
        row, end = self.ends[rule], start
        for at in range(start, len(data)):
            row = row[data[at]]
            if row[257]:
                break
            if row[256]:
                end = at + 1
        return end

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes: per rule leftmost longest, not overlapping."""
        row, marked = self.first, []
        for i, b in enumerate(data[::-1]):
            row = row[b]
            if row[256]:
                marked.append((i, row[256]))
        out, free, last = [], [0] * len(self.ends), len(data) - 1
        for i, mask in reversed(marked):
            start = last - i
            while mask:
                rule = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                if start >= free[rule]:
                    free[rule] = self.longest(data, start, rule)
                    out.append((start, rule, free[rule]))
        return out
