"""Rule expressions over bytes to one deterministic automaton: positions, subset construction, minimisation.

Expressions know literals, ``\\xHH`` and escaped marks, ``[...]`` and ``[^...]``, ``(...)``, ``(?i:...)`` for ASCII
letters, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}`` and ``{m,n}``. They mean what they mean in ``re`` on bytes; of the matches that begin
at a place the longest counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_ALL = frozenset(range(256))


class _Reader:
    """Recursive descent over one expression, straight to trees: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, low, high)."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def tree(self):
        found = self._either(False)
        if self.at < len(self.text):
            raise ValueError(f"{self.text!r}: unexpected {self.text[self.at]!r} at {self.at}")
        return found

    def _next(self) -> str:
        return self.text[self.at : self.at + 1]

    def _either(self, fold: bool):
        parts = [self._row(fold)]
        while self._next() == "|":
            self.at += 1
            parts.append(self._row(fold))
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _row(self, fold: bool):
        parts = []
        while self._next() not in ("", "|", ")"):
            part = self._atom(fold)
            while bounds := self._bounds():
                part = ("rep", part, *bounds)
            parts.append(part)
        return ("cat", parts)

    def _bounds(self) -> tuple[int, int | None] | None:
        mark = self._next()
        if mark in ("?", "*", "+") and mark:
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
        if mark != "{":
            return None
        close = self.text.index("}", self.at)
        low, _, high = (inside := self.text[self.at + 1 : close]).partition(",")
        self.at = close + 1
        return int(low), (int(high) if high else None) if "," in inside else int(low)

    def _atom(self, fold: bool):
        mark = self._next()
        if mark == "(":
            self.at += 1
            if self.text.startswith("?i:", self.at):
                self.at, fold = self.at + 3, True
            elif self._next() == "?":
                raise ValueError(f"{self.text!r}: unknown group at {self.at}")
            inner = self._either(fold)
            if self._next() != ")":
                raise ValueError(f"{self.text!r}: group is not closed")
            self.at += 1
            return inner
        if mark == "[":
            return ("set", self._class(fold))
        if mark in ("?", "*", "+", "{", ".", "^", "$"):
            raise ValueError(f"{self.text!r}: unexpected {mark!r} at {self.at}")
        return ("set", _folded({self._byte()}, fold))

    def _byte(self) -> int:
        char, self.at = self._next(), self.at + 1
        if char == "\\":
            char, self.at = self._next(), self.at + 1
            if char == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            if char.isalnum() or not char:
                raise ValueError(f"{self.text!r}: unknown escape \\{char}")
        if not char.isascii():
            raise ValueError(f"{self.text!r}: only ASCII is allowed")
        return ord(char)

    def _class(self, fold: bool) -> frozenset[int]:
        self.at += 1
        without = self._next() == "^"
        self.at += without
        held: set[int] = set()
        while self._next() != "]":
            low = high = self._byte()
            if self._next() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                high = self._byte()
            held.update(range(low, high + 1))
        self.at += 1
        found = _folded(held, fold)
        return _ALL - found if without else found


def _folded(held: set[int], fold: bool) -> frozenset[int]:
    letters = {b ^ 0x20 for b in held if chr(b).isascii() and chr(b).isalpha()} if fold else set()
    return frozenset(held | letters)


@dataclass
class Positions:
    """An expression without empty steps: each byte set of it is a position; a match walks from a first position along
    followers to a last one."""

    bytes_at: list[frozenset[int]] = field(default_factory=list)
    follow: list[set[int]] = field(default_factory=list)
    first: frozenset[int] = frozenset()
    last: frozenset[int] = frozenset()

    @classmethod
    def of(cls, expression: str) -> Positions:
        own = cls()
        empty, first, last = own._add(_Reader(expression).tree())
        if empty or any(p in last for p in first):
            raise ValueError(f"{expression!r}: matches of fewer than two bytes are not supported")
        own.first, own.last = frozenset(first), frozenset(last)
        return own

    def _add(self, tree) -> tuple[bool, set[int], set[int]]:
        """(matches nothing, first positions, last positions) of a tree, whose positions are added."""
        if tree[0] == "set":
            self.bytes_at.append(tree[1])
            self.follow.append(set())
            return False, {len(self.follow) - 1}, {len(self.follow) - 1}
        if tree[0] == "alt":
            parts = [self._add(x) for x in tree[1]]
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        if tree[0] == "cat":
            whole = (True, set(), set())
            for part in tree[1]:
                whole = self._joined(whole, self._add(part))
            return whole
        _, part, low, high = tree
        whole = (True, set(), set())
        for _ in range(max(low, 1) if high is None else high):
            end = self._add(part)
            low -= 1
            whole = self._joined(whole, (end[0] or low < 0, end[1], end[2]))
        if high is None:
            for p in end[2]:
                self.follow[p] |= end[1]
            whole = (whole[0] or tree[2] == 0, whole[1], whole[2])
        return whole

    def _joined(self, left, right):
        for p in left[2]:
            self.follow[p] |= right[1]
        return left[0] and right[0], left[1] | (right[1] if left[0] else set()), right[2] | (left[2] if right[0] else set())

    def turned(self) -> Positions:
        """The same matches read from their ends."""
        follow = [set() for _ in self.follow]
        for p, after in enumerate(self.follow):
            for q in after:
                follow[q].add(p)
        return Positions(self.bytes_at, follow, self.last, self.first)


def byte_classes(rules: list[Positions]) -> tuple[np.ndarray, list[int]]:
    """(class of each byte, a byte of each class): bytes that no position tells apart share a class."""
    sets = list(dict.fromkeys(s for rule in rules for s in rule.bytes_at))
    signs = [tuple(b in s for s in sets) for b in range(256)]
    number = {sign: i for i, sign in enumerate(dict.fromkeys(signs))}
    return np.array([number[s] for s in signs], np.uint8), [signs.index(s) for s in number]


def _explore(start, step, n_classes: int) -> tuple[list, np.ndarray]:
    """All states that steps reach, and their transitions."""
    number, states, rows = {start: 0}, [start], []
    while len(rows) < len(states):
        row = []
        for c in range(n_classes):
            state = step(states[len(rows)], c)
            if state not in number:
                number[state] = len(states)
                states.append(state)
            row.append(number[state])
        rows.append(row)
    return states, np.array(rows, np.int64)


def ends_automaton(rule: Positions, samples: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(transitions, accepting) of the subset automaton that marks every byte at which the leftmost match may end, over a
    text read once: the last mark in a row is its longest end, and the next match is looked for behind it.

    A state lists the sets of positions of the starts that are still alive, earliest start first; a position that an earlier
    start holds is dropped from later ones. Once a start has matched, later ones are dropped. An expression whose match may
    go on after a gap, or end while an earlier start is alive, can't be marked in one pass and raises ValueError.
    """

    def after(held: frozenset[int], byte: int) -> frozenset[int]:
        return frozenset(q for p in held for q in rule.follow[p] if byte in rule.bytes_at[q])

    def step(state: tuple[frozenset[int], ...], c: int) -> tuple[frozenset[int], ...]:
        byte = samples[c]
        fresh = frozenset(q for q in rule.first if byte in rule.bytes_at[q])
        if state and state[0] & rule.last:
            on = after(state[0], byte)
            if on and not on & rule.last:
                raise ValueError("a match may go on after a gap; write two rules")
            return (on,) if on else ((fresh,) if fresh else ())
        out, seen = [], frozenset()
        for held in (*(after(s, byte) for s in state), fresh):
            if own := held - seen:
                out.append(own)
                seen |= own
        for i, own in enumerate(out):
            if own & rule.last:
                if i:
                    raise ValueError("a match may end while an earlier start is alive; write two rules")
                return (own,)
        return tuple(out)

    states, table = _explore((), step, len(samples))
    return table, np.array([bool(s) and bool(s[0] & rule.last) for s in states])


def starts_automaton(rule: Positions, samples: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(transitions, accepting) of the subset automaton that reads a match backwards from its end."""
    back = rule.turned()
    begin = frozenset({-1})

    def step(state: frozenset[int], c: int) -> frozenset[int]:
        after = back.first if state == begin else {q for p in state for q in back.follow[p]}
        return frozenset(q for q in after if samples[c] in back.bytes_at[q])

    states, table = _explore(begin, step, len(samples))
    return table, np.array([bool(s & back.last) for s in states])


def minimal(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least automaton with the same marks from state 0 on: blocks of equal marks are split until all states of a block
    go to the same blocks."""
    block = np.unique(marks, return_inverse=True)[1]
    count = 0
    while block.max() + 1 > count:
        count = block.max() + 1
        block = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
    _, one = np.unique(block, return_index=True)
    order = np.argsort(one)  # the block of state 0 comes first
    number = np.empty_like(order)
    number[order] = np.arange(len(order))
    one = one[order]
    return number[block[table[one]]], marks[one]


def together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One automaton that runs all ``parts`` side by side, as far as texts reach it, made least again. A state's mark has
    bit r where part r accepts."""
    sizes = [len(t) for t, _ in parts]
    radix = np.concatenate([[1], np.cumprod(np.array(sizes[:-1], object))])
    if len(parts) > 62 or radix[-1] * sizes[-1] >= 2**62:
        raise ValueError("too many rules for one automaton")
    radix = radix.astype(np.int64)
    codes, rows, front = np.zeros(1, np.int64), [], np.zeros(1, np.int64)
    while len(front):
        to = sum(t[front // w % n] * w for (t, _), w, n in zip(parts, radix, sizes))
        rows.append(to)
        front = np.setdiff1d(to, codes)
        codes = np.concatenate([codes, front])
    order = np.argsort(codes)
    table = order[np.searchsorted(codes, np.concatenate(rows), sorter=order)]
    marks = sum(a[codes // w % n].astype(np.int64) << r for r, ((_, a), w, n) in enumerate(zip(parts, radix, sizes)))
    return minimal(table, marks)
