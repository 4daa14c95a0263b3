"""Byte automata: regular expressions to minimal deterministic automata.

``compile_rules`` joins several rules in one automaton by Thompson's
construction, subset construction over classes of equivalent bytes and
partition refinement; ``Automaton.ends`` walks it once over a whole buffer.
"""

from __future__ import annotations

from re import _constants as sc
from re import _parser as sp
import re

import numpy as np

#: Bytes walked one after another in one lane, and lanes under which the last
#: lanes are finished by a plain loop.
LANE, FEW = 2048, 4


class Nfa:
    """Thompson automaton over byte sets."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.move: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.move.append(None)
        return len(self.eps) - 1

    def add(self, tree, start: int, reverse: bool, fold: bool = False) -> int:
        """Adds a parsed expression from ``start``; returns its end state."""
        for op, arg in (reversed(list(tree)) if reverse else tree):
            start = self.node(op, arg, start, reverse, fold)
        return start

    def node(self, op, arg, start: int, reverse: bool, fold: bool) -> int:
        if op is sc.LITERAL or op is sc.IN or op is sc.ANY:
            end = self.state()
            mid = self.state()
            self.eps[start].append(mid)
            self.move[mid] = (byte_set(op, arg, fold), end)
            return end
        if op is sc.SUBPATTERN:
            _, on, _, inner = arg
            return self.add(inner, start, reverse, fold or bool(on & re.IGNORECASE))
        if op is sc.BRANCH:
            end = self.state()
            for inner in arg[1]:
                first = self.state()
                self.eps[start].append(first)
                self.eps[self.add(inner, first, reverse, fold)].append(end)
            return end
        if op is sc.MAX_REPEAT:
            least, most, inner = arg
            for _ in range(least):
                start = self.add(inner, start, reverse, fold)
            if most is sc.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.eps[start].append(loop)
                self.eps[self.add(inner, loop, reverse, fold)].append(loop)
                self.eps[loop].append(end)
                return end
            end = self.state()
            for _ in range(most - least):
                self.eps[start].append(end)
                start = self.add(inner, start, reverse, fold)
            self.eps[start].append(end)
            return end
        raise ValueError(f"not supported in a rule: {op}")

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.eps[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


def byte_set(op, arg, fold: bool) -> frozenset:
    if op is sc.ANY:
        return frozenset(set(range(256)) - {10})
    out: set[int] = set()
    for kind, value in ([(op, arg)] if op is sc.LITERAL else arg):
        if kind is sc.LITERAL:
            out.add(value)
        elif kind is sc.RANGE:
            out |= set(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {kind}")
    if fold:
        out |= {ord(chr(b).swapcase()) for b in out if chr(b).isascii() and chr(b).isalpha()}
    return frozenset(out)


class Automaton:
    """Minimal automaton: ``table[state * classes + class of byte]``; state 0
    is the start; ``accept`` has one bit for each rule."""

    def __init__(self, patterns: list[str], anchored: bool, reverse: bool = False) -> None:
        nfa = Nfa()
        root = nfa.state()
        finals = {}
        for k, pattern in enumerate(patterns):
            first = nfa.state()
            nfa.eps[root].append(first)
            finals[nfa.add(sp.parse(pattern), first, reverse)] = k
        sets = sorted({m[0] for m in nfa.move if m}, key=sorted)
        kinds: dict[tuple, int] = {}
        self.byte_class = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)],
                                   np.int64)
        sample = [int(np.flatnonzero(self.byte_class == c)[0]) for c in range(len(kinds))]
        self.classes = len(kinds)
        closure = {s: nfa.closure([s]) for m in nfa.move if m for s in (m[1],)}
        moves = [[(c, closure[m[1]]) for c, b in enumerate(sample) if b in m[0]] if m else [] for m in nfa.move]
        start = nfa.closure([root])
        always = frozenset() if anchored else start
        number, todo, table, accept = {start: 0}, [start], [], []
        for here in todo:
            accept.append(sum(1 << finals[s] for s in here if s in finals))
            to: list[set] = [set(always) for _ in sample]
            for s in here:
                for c, reached in moves[s]:
                    to[c] |= reached
            row = []
            for after in map(frozenset, to):
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row.append(number[after])
            table.append(row)
        self.table, self.accept = minimised(np.array(table, np.int64), np.array(accept, np.int64))
        self.dead = np.array([(row == k).all() and not self.accept[k] for k, row in enumerate(self.table)])
        #: bytes after which every state is the start state: no match holds them
        self.reset = (self.table == 0).all(0)[self.byte_class] if not anchored else None
        self.flat = (self.table * self.classes).ravel()

    def ends(self, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position after the last byte, rules) wherever a rule accepts.
        Lanes begin behind reset bytes, so each starts in the start state."""
        n = len(body)
        cuts = np.flatnonzero(self.reset[body])
        at = np.searchsorted(cuts, np.arange(LANE, n, LANE))
        start = np.unique(np.concatenate(([0], cuts[at[at < len(cuts)]] + 1)))
        length = np.diff(np.append(start, n))
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        cls = self.byte_class.astype(np.uint8)[body]
        hot = np.zeros(len(self.flat), bool)
        hot[np.flatnonzero(self.accept) * self.classes] = True
        state = np.zeros(len(start), np.int64)
        where, which = [], []
        active, t = len(start), 0
        longest = int(length[0]) if n else 0
        fewer = np.searchsorted(-length, -np.arange(longest + 1), "left")  # lanes longer than t
        while t < longest:
            active = int(fewer[t])
            if active < FEW:
                break
            state = self.flat[state[:active] + cls[start[:active] + t]]
            found = hot[state]
            if found.any():
                k = np.flatnonzero(found)
                where.append(start[k] + t + 1)
                which.append(self.accept[state[k] // self.classes])
            t += 1
        if t < longest:
            flat, accept, c = self.flat.tolist(), self.accept.tolist(), self.classes
            for lane in range(int(fewer[t])):
                s, begin, stop = int(state[lane]), int(start[lane]), int(start[lane] + length[lane])
                out_at, out_by = [], []
                for p, b in enumerate(cls[begin + t:stop].tolist(), begin + t + 1):
                    s = flat[s + b]
                    if accept[s // c]:
                        out_at.append(p)
                        out_by.append(accept[s // c])
                where.append(np.array(out_at, np.int64))
                which.append(np.array(out_by, np.int64))
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, which = np.concatenate(where), np.concatenate(which)
        order = np.argsort(where, kind="stable")
        return where[order], which[order]

    def longest_back(self, body: bytes, end: int, least: int) -> int:
        """Smallest start >= ``least`` of a match of this reversed, anchored
        automaton that ends at ``end``; -1 if there is none."""
        s, best = 0, -1
        for p in range(end - 1, least - 1, -1):
            s = int(self.table[s, self.byte_class[body[p]]])
            if self.dead[s]:
                break
            if self.accept[s]:
                best = p
        return best


def minimised(table: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition refinement; the start stays state 0."""
    _, part = np.unique(accept, return_inverse=True)
    count = part.max() + 1
    while True:
        _, part = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        part = part.ravel()
        if part.max() + 1 == count:
            break
        count = part.max() + 1
    _, first = np.unique(part, return_index=True)
    rank = np.empty(count, np.int64)
    rank[part[np.sort(first)]] = np.arange(count)
    keep = np.sort(first)
    return rank[part[table[keep]]], accept[keep]
