"""Regular expressions compiled to deterministic byte automata.

A pattern is parsed to a small tree, turned into a Thompson automaton over
bytes, made deterministic by subset construction over byte classes and minimised
by partition refinement. Supported: literals, escapes, classes, groups,
alternation and greedy repetition, all over ASCII. The result is a dense
transition array, so a scan is one table lookup a byte.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Cells fewer than this are finished one by one: a step over all costs as much as this many.
FEW = 24


# Trees: ("set", bytes), ("seq", parts), ("alt", options), ("rep", least, most or None, part).


class _Parser:
    def __init__(self, pattern: str, fold: bool):
        if not pattern.isascii():
            raise ValueError("patterns are ASCII")
        self.rest, self.fold = list(reversed(pattern)), fold

    def peek(self) -> str:
        return self.rest[-1] if self.rest else ""

    def options(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.rest.pop()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("alt", found)

    def sequence(self):
        parts = []
        while self.rest and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("seq", parts)

    def atom(self):
        c = self.rest.pop()
        if c == "(":
            inside = self.options()
            if not self.rest or self.rest.pop() != ")":
                raise ValueError("a group isn't closed")
            return inside
        if c == "[":
            return self.members()
        if c in "*+?{.^$":
            raise ValueError(f"pattern part {c} is not supported")
        return self.of({self.escaped() if c == "\\" else ord(c)})

    def escaped(self) -> int:
        c = self.rest.pop()
        if c == "x":
            return int(self.rest.pop() + self.rest.pop(), 16)
        if c.isalnum():
            raise ValueError(f"escape {c} is not supported")
        return ord(c)

    def members(self):
        chars: set[int] = set()
        if self.peek() == "^":
            raise ValueError("negated classes are not supported")
        while (c := self.rest.pop()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.rest[-2] != "]":
                self.rest.pop()
                c = self.rest.pop()
                chars.update(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                chars.add(low)
        return self.of(chars)

    def of(self, chars: set[int]):
        if self.fold:
            chars = {ord(f(chr(c))) for c in chars for f in (str.lower, str.upper)}
        return ("set", frozenset(chars))

    def repeated(self, part):
        while self.peek() and self.peek() in "*+?{":
            c = self.rest.pop()
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1), "{": (0, 0)}[c]
            if c == "{":
                text = ""
                while (d := self.rest.pop()) != "}":
                    text += d
                a, comma, b = text.partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
            part = ("rep", low, high, part)
        return part


def parse(pattern: str, fold: bool = False):
    parser = _Parser(pattern, fold)
    tree = parser.options()
    if parser.rest:
        raise ValueError("a group isn't open")
    return tree


def shortest(tree):
    """The tree with a repetition at its end cut to its fewest turns: whatever
    begins a match of one begins a match of the other."""
    if tree[0] == "seq" and tree[1] and tree[1][-1][0] == "rep":
        _, low, _, part = tree[1][-1]
        return ("seq", [*tree[1][:-1], ("rep", low, low, part)])
    return tree


def backward(tree):
    """The tree of the same texts read from their ends."""
    kind = tree[0]
    if kind == "seq":
        return ("seq", [backward(t) for t in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [backward(t) for t in tree[1]])
    return ("rep", tree[1], tree[2], backward(tree[3])) if kind == "rep" else tree


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.on: list[list[tuple[frozenset[int], int]]] = []

    def node(self) -> int:
        self.eps.append([])
        self.on.append([])
        return len(self.eps) - 1

    def build(self, tree, start: int) -> int:
        """Hang a tree on a node; returns the node where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.node()
            self.on[start].append((tree[1], end))
            return end
        if kind == "seq":
            for part in tree[1]:
                start = self.build(part, start)
            return start
        end = self.node()
        if kind == "alt":
            for option in tree[1]:
                first = self.node()
                self.eps[start].append(first)
                self.eps[self.build(option, first)].append(end)
            return end
        _, low, high, part = tree
        for _ in range(low):
            start = self.build(part, start)
        if high is None:
            loop = self.node()
            self.eps[start].append(loop)
            self.eps[self.build(part, loop)].append(loop)
            self.eps[loop].append(end)
            return end
        self.eps[start].append(end)
        for _ in range(high - low):
            start = self.build(part, start)
            self.eps[start].append(end)
        return end


@dataclass(frozen=True)
class Dfa:
    """next[state * 256 + byte]; accept[state] has bit k where pattern k ends;
    alive[state] has bit k where it can still end."""

    next: np.ndarray
    accept: np.ndarray
    start: int
    alive: np.ndarray = field(init=False)

    def __post_init__(self):
        table, alive = self.next.reshape(-1, 256), self.accept.copy()
        while True:
            more = alive | np.bitwise_or.reduce(alive[table], axis=1)
            if (more == alive).all():
                break
            alive = more
        object.__setattr__(self, "alive", alive)

    @property
    def states(self) -> int:
        return len(self.accept)

    def resets(self) -> np.ndarray:
        """For each byte, whether every state goes to the start on it."""
        return (self.next.reshape(-1, 256) == self.start).all(0)

    def ends(self) -> np.ndarray:
        """For each byte, whether nothing is alive after it."""
        return (self.alive[self.next.reshape(-1, 256)] == 0).all(0)


def compile_trees(trees: list, floating: bool) -> Dfa:
    """One minimal automaton for all trees. Floating: a match may begin at any
    byte; else only at the first."""
    nfa = _Nfa()
    begin, ends = nfa.node(), {}
    for k, tree in enumerate(trees):
        first = nfa.node()
        nfa.eps[begin].append(first)
        ends[nfa.build(tree, first)] = k

    def closure(nodes) -> frozenset[int]:
        found, todo = set(nodes), list(nodes)
        while todo:
            for n in nfa.eps[todo.pop()]:
                if n not in found:
                    found.add(n)
                    todo.append(n)
        return frozenset(found)

    marks = np.zeros((256, 0), bool)
    for chars in {c for moves in nfa.on for c, _ in moves}:
        column = np.zeros((256, 1), bool)
        column[list(chars)] = True
        marks = np.hstack((marks, column))
    _, sample, kind = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    kind = kind.reshape(-1)

    first = closure([begin])
    index, todo, rows = {first: 0}, [first], []
    while len(rows) < len(todo):
        state, row = todo[len(rows)], []
        for byte in sample.tolist():
            to = {n for s in state for chars, n in nfa.on[s] if byte in chars}
            to = closure(to | {begin} if floating else to)
            if to not in index:
                index[to] = len(index)
                todo.append(to)
            row.append(index[to])
        rows.append(row)
    move = np.array(rows)
    accept = np.array([sum(1 << k for e, k in ends.items() if e in s) for s in todo], np.int64)

    part = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:
        new = np.unique(np.column_stack((part, part[move])), axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == part.max():
            break
        part = new
    keep = np.unique(part, return_index=True)[1]
    table = part[move[keep]][:, kind]
    return Dfa(np.ascontiguousarray(table.astype(np.int32)).reshape(-1), accept[keep], int(part[0]))


class Walker:
    """An anchored automaton followed from one place, in time that grows with
    what the pattern can still match there."""

    def __init__(self, dfa: Dfa):
        self.rows, self.start = dfa.next.reshape(-1, 256).tolist(), dfa.start
        self.accept, self.alive = dfa.accept.tolist(), dfa.alive.tolist()

    def longest(self, data: bytes, at: int, k: int = 0) -> int:
        """End of pattern k's longest match that begins at `at`, or -1."""
        state, end, bit = self.start, -1, 1 << k
        rows, accept, alive = self.rows, self.accept, self.alive
        for i in range(at, len(data)):
            state = rows[state][data[i]]
            if not alive[state] & bit:
                break
            if accept[state] & bit:
                end = i + 1
        return end


def scan_backward(dfa: Dfa, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, accept bits), by place, where cells data[begin : begin + size],
    read from their ends, meet accepting states; all cells advance together."""
    order = np.argsort(-size, kind="stable")
    size, end = size[order], (begin + size)[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    together = int(np.searchsorted(-active, -FEW, "right"))
    state = np.full(len(size), dfa.start, np.int32)
    move, accept = dfa.next, dfa.accept
    marks = accept != 0
    places, bits = [], []
    for k, n in enumerate(active[:together].tolist()):
        at = end[:n] - 1 - k
        state = move[(state[:n] << 8) + data[at]]
        hit = marks[state]
        if hit.any():
            places.append(at[hit])
            bits.append(accept[state[hit]])
    if together < longest:
        rows, told = move.reshape(-1, 256).tolist(), accept.tolist()
        for c in range(int(active[together])):
            s, low = int(state[c]), int(end[c] - size[c])
            some, what = [], []
            stop = int(end[c]) - together
            raw = data[low:stop].tobytes()
            for i in range(len(raw) - 1, -1, -1):
                s = rows[s][raw[i]]
                if told[s]:
                    some.append(low + i)
                    what.append(told[s])
            places.append(np.array(some, np.int64))
            bits.append(np.array(what, np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, what = np.concatenate(places), np.concatenate(bits)
    by = np.argsort(where, kind="stable")
    return where[by], what[by]
