"""Rule patterns compiled into one minimal deterministic automaton over bytes.

``compile_rules`` parses each pattern, joins the position automata of all rules, turns them into a
deterministic one by subset construction over byte classes and minimises it by partition
refinement. The result is plain arrays: a class per byte, a transition table of states by classes
and, per state, a bit per rule that accepts there.

The patterns are a small language over ASCII: literals, escapes (``\\x20``, ``\\.``), classes, groups,
``(?i:...)`` for letters in either case, alternation, and ``? * + {m} {m,} {m,n}``. Matches are the
leftmost ones and the longest from there, which for patterns whose parts begin with distinct
characters are those of a backtracking engine.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np

MAX_STATES = 50_000


class Automaton(NamedTuple):
    classes: np.ndarray  # 256: class of a byte
    table: np.ndarray    # states x classes: next state; state 0 is the start
    accepts: np.ndarray  # states: bit r is set where rule r accepts

    def rows(self) -> list[list]:
        """State 0 as nested lists: ``row[byte]`` is the next row, ``row[256]`` its accepting rules."""
        out: list[list] = [[] for _ in self.accepts]
        wide = self.table[:, self.classes]
        for state, row in enumerate(out):
            row.extend(out[x] for x in wide[state].tolist())
            row.append(int(self.accepts[state]))
        return out

    def dead(self) -> int:
        """The state that is never left and never accepts."""
        stays = (self.table == np.arange(len(self.table))[:, None]).all(axis=1)
        return int(np.flatnonzero(stays & (self.accepts == 0))[0])


# A pattern is a tree: ("set", frozenset of bytes), ("cat", [trees]), ("alt", [trees]), ("rep", tree, least, most or None).


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self, expected: str | None = None) -> str:
        c = self.peek()
        if not c or (expected and c != expected):
            raise ValueError(f"{expected or 'a character'} expected at {self.i} of {self.p!r}")
        self.i += 1
        return c

    def parse(self):
        tree = self.alternatives()
        if self.peek():
            raise ValueError(f"unexpected {self.peek()!r} at {self.i} of {self.p!r}")
        return tree

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        tree = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                low, _, high = self.until("}").partition(",")
                least = int(low)
                most = int(high) if high else None if self.p[self.i - 2] == "," else least
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tree = ("rep", tree, least, most)
        return tree

    def until(self, end: str) -> str:
        start = self.i
        while self.take() != end:
            pass
        return self.p[start:self.i - 1]

    def char(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                return int(self.take() + self.take(), 16)
            if c.isalnum():
                raise ValueError(f"escape \\{c} is not part of this language")
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            outer = self.fold
            if self.peek() == "?":
                flags = self.until(":")
                if flags not in ("?:", "?i", "?"):
                    raise ValueError(f"({flags}: is not part of this language")
                self.fold = outer or flags == "?i"
            tree = self.alternatives()
            self.take(")")
            self.fold = outer
            return tree
        if c == "[":
            self.take()
            return ("set", self.folded(self.class_bytes()))
        return ("set", self.folded({self.char()}))

    def class_bytes(self) -> set[int]:
        out: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.p[self.i + 1:self.i + 2] != "]":
                self.take()
                out.update(range(low, self.char() + 1))
            else:
                out.add(low)
        self.take("]")
        return out

    def folded(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars = chars | {ord(x) for c in chars for x in (chr(c).lower(), chr(c).upper())}
        return frozenset(chars)


def _backward(tree):
    """The tree of the reversed words."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [_backward(t) for t in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [_backward(t) for t in tree[1]])
    return ("rep", _backward(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Positions:
    """Position automaton: one position per byte set; ``follow`` tells what may come next."""

    def __init__(self):
        self.sets: list[frozenset[int]] = []
        self.follow: list[set[int]] = []

    def add(self, tree) -> tuple[set[int], set[int], bool]:
        """(first positions, last positions, whether the empty word is in) of a tree."""
        kind = tree[0]
        if kind == "set":
            self.sets.append(tree[1])
            self.follow.append(set())
            at = {len(self.sets) - 1}
            return at, at, False
        if kind == "alt":
            got = [self.add(t) for t in tree[1]]
            return set().union(*[g[0] for g in got]), set().union(*[g[1] for g in got]), any(g[2] for g in got)
        if kind == "cat":
            return self.chain([self.add(t) for t in tree[1]])
        _, inner, least, most = tree
        if most is None:
            copies = [self.add(inner) for _ in range(max(1, least))]
            for p in copies[-1][1]:
                self.follow[p] |= copies[-1][0]
            if least == 0:
                copies[-1] = (copies[-1][0], copies[-1][1], True)
            return self.chain(copies)
        copies = [self.add(inner) for _ in range(most)]
        return self.chain([(f, e, empty or i >= least) for i, (f, e, empty) in enumerate(copies)])

    def chain(self, parts) -> tuple[set[int], set[int], bool]:
        first, last, empty = set(), set(), True
        for f, e, can_skip in parts:
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | e if can_skip else set(e)
            empty = empty and can_skip
        return first, last, empty


def _byte_classes(sets: Iterable[frozenset[int]]) -> tuple[np.ndarray, list[int]]:
    """Bytes that lie in the same sets share a class; a sample byte per class."""
    member = np.array([[b in s for b in range(256)] for s in set(sets)], dtype=np.uint8).reshape(-1, 256)
    _, sample, classes = np.unique(member, axis=1, return_index=True, return_inverse=True)
    return classes.reshape(256).astype(np.int32), sample.tolist()


def _minimised(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart; the start stays state 0."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = {b: i for i, b in enumerate(dict.fromkeys(block.tolist()))}  # state 0 comes first
    block = np.array([order[b] for b in block.tolist()])
    _, sample = np.unique(block, return_index=True)
    return block[table[sample]].astype(np.int32), accepts[sample]


def compile_rules(patterns: list[str], anywhere: bool = True, backward: bool = False,
                  max_states: int = MAX_STATES) -> Automaton:
    """The automaton of all patterns: begun at every byte (``anywhere``) or at the first only, over the words or,
    ``backward``, over the reversed words. More than ``max_states`` states before minimisation are an error."""
    places = _Positions()
    start, ends = set(), {}
    for r, pattern in enumerate(patterns):
        tree = _Parser(pattern).parse()
        first, last, empty = places.add(_backward(tree) if backward else tree)
        if empty:
            raise ValueError(f"{pattern!r} matches the empty text")
        start |= first
        for p in last:
            ends[p] = ends.get(p, 0) | 1 << r
    classes, sample = _byte_classes(places.sets)
    taken = [{p for p, s in enumerate(places.sets) if b in s} for b in sample]  # positions that read a byte of the class
    begin, dead = frozenset(), frozenset({-1})  # no position read yet; none left
    index, queue, table = {begin: 0}, [begin], []
    for state in queue:
        after = set(start) if anywhere or state is begin else set()
        if state != dead:
            after = after.union(*[places.follow[p] for p in state])
        row = []
        for t in taken:
            nxt = frozenset(after & t) or (begin if anywhere else dead)
            if nxt not in index:
                index[nxt] = len(queue)
                queue.append(nxt)
                if len(queue) > max_states:
                    raise ValueError(f"the rules need more than {max_states} states")
            row.append(index[nxt])
        table.append(row)
    accepts = np.array([reduce(or_, [ends.get(p, 0) for p in s], 0) for s in queue], dtype=np.int64)
    return Automaton(classes, *_minimised(np.array(table, dtype=np.int32), accepts))
