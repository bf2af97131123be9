"""Regular expressions to one minimised transition table over bytes.

A rule is parsed by the standard library's parser, becomes an NFA, and all NFAs together become one DFA by subset
construction; the DFA is minimised by partition refinement and stored as an array over byte classes. An accepting state knows
which rules end there. The same construction gives each rule its own anchored tables, forwards and reversed.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

import numpy as np


class _Nfa:
    def __init__(self):
        self.step: list[list[tuple[frozenset, int]]] = []
        self.skip: list[list[int]] = []

    def node(self) -> int:
        self.step.append([])
        self.skip.append([])
        return len(self.step) - 1

    def sequence(self, items, at: int, fold: bool) -> int:
        for op, arg in items:
            at = self.item(op, arg, at, fold)
        return at

    def item(self, op, arg, at: int, fold: bool) -> int:
        if op is C.SUBPATTERN:
            return self.sequence(arg[3], at, (fold or bool(arg[1] & 2)) and not arg[2] & 2)
        if op is C.BRANCH:
            end = self.node()
            for alt in arg[1]:
                self.skip[self.sequence(alt, at, fold)].append(end)
            return end
        if op is C.MAX_REPEAT:
            low, high, body = arg
            for _ in range(low):
                at = self.sequence(body, at, fold)
            if high is C.MAXREPEAT:
                loop = self.node()
                self.skip[at].append(loop)
                self.skip[self.sequence(body, loop, fold)].append(loop)
                return loop
            end = self.node()
            for _ in range(high - low):
                self.skip[at].append(end)
                at = self.sequence(body, at, fold)
            self.skip[at].append(end)
            return end
        end = self.node()
        self.step[at].append((_bytes_of(op, arg, fold), end))
        return end

    def reversed(self) -> _Nfa:
        r = _Nfa()
        for _ in self.step:
            r.node()
        for a, out in enumerate(self.step):
            for chars, b in out:
                r.step[b].append((chars, a))
        for a, out in enumerate(self.skip):
            for b in out:
                r.skip[b].append(a)
        return r


def _bytes_of(op, arg, fold: bool) -> frozenset:
    if op is C.LITERAL:
        chars = {arg}
    elif op is C.NOT_LITERAL:
        chars = set(range(256)) - {arg}
    elif op is C.IN:
        chars, negate = set(), False
        for kind, x in arg:
            if kind is C.NEGATE:
                negate = True
            elif kind is C.RANGE:
                chars |= set(range(x[0], x[1] + 1))
            else:
                chars |= _bytes_of(kind, x, False)
        if negate:
            chars = set(range(256)) - chars
    else:
        raise ValueError(f"not a regular construct: {op}")
    if fold:
        chars |= {ord(chr(c).lower()) for c in chars if 65 <= c <= 90} | {ord(chr(c).upper()) for c in chars if 97 <= c <= 122}
    return frozenset(chars)


class Dfa:
    """`table[state * width + classes[byte]]` is the next state times width. States from `accepting` on are accepting, and
    `rules[state]` lists the rules that end there. State 0 is the start; `dead` (if any) is where nothing can match any more."""

    def __init__(self, table, classes, width, start, accepting, rules, dead):
        self.table, self.classes, self.width, self.start = table, classes, width, start
        self.accepting, self.rules, self.dead = accepting, rules, dead


def _determinise(nfa: _Nfa, starts: list[int], ends: dict[int, int], search: bool) -> Dfa:
    def closure(nodes) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for b in nfa.skip[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    sets = {chars for out in nfa.step for chars, _ in out}
    kinds: dict[tuple, int] = {}
    classes = bytearray(256)
    ordered = sorted(sets, key=sorted)
    sample = []
    for b in range(256):
        key = tuple(b in s for s in ordered)
        if key not in kinds:
            kinds[key] = len(kinds)
            sample.append(b)
        classes[b] = kinds[key]
    width = len(kinds)
    first = closure(starts)
    index, todo, rows = {first: 0}, [first], []
    while todo:
        state = todo.pop(0)
        row = []
        for b in sample:
            nxt = {t for n in state if not (search and n in ends) for chars, t in nfa.step[n] if b in chars}
            nxt = closure(nxt | set(starts)) if search else closure(nxt)
            if nxt not in index:
                index[nxt] = len(index)
                todo.append(nxt)
            row.append(index[nxt])
        rows.append(row)
    table = np.array(rows, dtype=np.int64)
    accepts = [tuple(sorted({ends[n] for n in s if n in ends})) for s in index]
    return _minimised(table, accepts, bytes(classes), width)


def _minimised(table: np.ndarray, accepts: list[tuple], classes: bytes, width: int) -> Dfa:
    """Moore's refinement: states stay together while they accept the same rules and step into the same blocks."""
    names = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    block = np.array([names[a] for a in accepts])
    while True:
        _, new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == block.max():
            break
        block = new
    n = int(block.max()) + 1
    rep = np.full(n, -1)
    for s in range(len(table) - 1, -1, -1):
        rep[block[s]] = s
    order = sorted(range(n), key=lambda b: (bool(accepts[rep[b]]), rep[b]))     # the start first, accepting states last
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    out = place[block[table[rep[order]]]]
    rules = [accepts[rep[b]] for b in order]
    accepting = next((i for i, r in enumerate(rules) if r), n)
    dead = next((i for i in range(accepting) if (out[i] == i).all()), None)
    start = int(place[block[0]])
    return Dfa((out * width).reshape(-1).tolist(), classes, width, start * width, accepting * width,
               {i * width: r for i, r in enumerate(rules) if r}, None if dead is None else dead * width)


def _nfa(pattern: bytes, nfa: _Nfa) -> tuple[int, int]:
    start = nfa.node()
    return start, nfa.sequence(_parser.parse(pattern), start, False)


def searcher(patterns: list[bytes]) -> Dfa:
    """One table that finds in a single pass where a match of any rule is first complete (a longer match goes on from there,
    which the rule's own table follows; leaving that out here keeps the joint table small)."""
    nfa, starts, ends = _Nfa(), [], {}
    for i, p in enumerate(patterns):
        s, e = _nfa(p, nfa)
        starts.append(s)
        ends[e] = i
    return _determinise(nfa, starts, ends, True)


def anchored(pattern: bytes) -> tuple[Dfa, Dfa]:
    """The rule forwards from its first byte, and backwards from its last."""
    nfa = _Nfa()
    s, e = _nfa(pattern, nfa)
    return _determinise(nfa, [s], {e: 0}, False), _determinise(nfa.reversed(), [e], {s: 0}, False)


def reach(dfa: Dfa, data: bytes, at: int, limit: int) -> int:
    """The longest match of the rule from byte `at` towards `limit`: its exclusive end going forwards (limit > at), its first
    byte going backwards (data[at] is then the last one, and `limit` the one before the earliest allowed). None if there is none."""
    step = 1 if limit >= at else -1
    state, best, classes = dfa.start, None, dfa.classes
    table, accepting, dead = dfa.table, dfa.accepting, dfa.dead
    while at != limit:
        state = table[state + classes[data[at]]]
        if state == dead:
            break
        at += step
        if state >= accepting:
            best = at
    return best if best is None or step > 0 else best + 1
