"""Licence scan with a generalised suffix automaton over licence words.

The automaton holds every run of words of every template. A text streams through it word by word and yields matching
statistics: at each word, the longest run ending there that some template contains. Runs that cannot be extended are chained
per template, in order on both sides, and the share of the template that the best chain covers is the template's score. A run is laid
at every place of a template where it stands. The template with most covered words claims its part of the text first; one
that has no half of its words left outside of claimed parts gives no label, so a licence is not also taken for one that it contains.

Null or empty text: no words, no labels, score 0. Repeated rows each give a row. Other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts
from .license_texts import TEMPLATES

# Phrases and labels of the contract.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

LEAST_RUN = 5       # words of a run that counts
LARGEST_GAP = 20    # words between two runs of a chain, on either side
COVERED = 0.5       # share of a template that gives its label

# Everything that is no word character (digits, a-z, bytes beyond ASCII) becomes a space; A-Z are lower-cased.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class SuffixAutomaton:
    """States are sets of end places of word runs; `ends[state]` maps a template to all places where the state's runs end."""

    def __init__(self, templates: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for t, run in enumerate(templates):
            last = 0
            for i, w in enumerate(run):
                last = self._extend(last, w)
                self.ends[last].setdefault(t, set()).add(i)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for t, places in self.ends[s].items():
                self.ends[self.link[s]].setdefault(t, set()).update(places)

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The part of q whose runs are one word longer than those of p, as a state of its own."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][w], w)
        return new

    def runs(self, text: list[bytes]) -> list[tuple[int, int, int]]:
        """(last word, length, state) of every run that the following word does not extend."""
        out, nxt, link, length_of = [], self.next, self.link, self.length
        state = length = 0
        for i, w in enumerate(text):
            to = nxt[state].get(w)
            if to is not None:
                state, length = to, length + 1
                continue
            if length:
                if length >= LEAST_RUN:
                    out.append((i - 1, length, state))
                while state and w not in nxt[state]:
                    state = link[state]
                    length = length_of[state]
                if w in nxt[state]:
                    state, length = nxt[state][w], length + 1
        if length >= LEAST_RUN:
            out.append((len(text) - 1, length, state))
        return out


def chains(runs: list[tuple[int, int, int]], machine: SuffixAutomaton, sizes: list[int]) -> list[tuple[int, int, int, float]]:
    """(template, first word, last word, covered share) of each template's best chain."""
    by: dict[int, list] = {}
    for last, length, state in runs:
        for t, places in machine.ends[state].items():
            by.setdefault(t, []).extend((last - length + 1, last, end - length + 1, end) for end in sorted(places))
    out = []
    for t, found in sorted(by.items()):
        best, open_ = (0, 0, 0), []         # open_: (covered words, first, last, place in the template) of chains that may go on
        for first, last, a, b in found:
            open_ = [c for c in open_ if first - c[2] <= LARGEST_GAP + b - a]
            pick = (b - a + 1, first, last, b)
            for covered, f, to, at in open_:
                if at < b and to < last and a - at <= LARGEST_GAP + 1 and covered + b - max(a - 1, at) > pick[0]:
                    pick = (covered + b - max(a - 1, at), f, last, b)
            open_.append(pick)
            best = max(best, (pick[0], -pick[1], pick[2]))
        out.append((t, -best[1], best[2], best[0] / sizes[t]))
    return out


def claimed(found: list[tuple[int, int, int, float]], sizes: list[int]) -> list[tuple[int, int, int, float]]:
    """The chains that give their template's label: most covered words first, ties by share, and each on the words that are left to it."""
    taken: set[int] = set()
    out = []
    for c in sorted(found, key=lambda c: (-round(c[3] * sizes[c[0]]), -c[3], c[0])):
        part = range(c[1], c[2] + 1)
        free = sum(i not in taken for i in part) / len(part)
        if c[3] * free >= COVERED:
            out.append(c)
            taken.update(part)
    return sorted(out)


def scan(df: DataFrame, keep: list[str], text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """`keep`, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:first:last of covered templates)."""
    names = [n for n, _ in templates]
    bodies = [words(body.encode()) for _, body in templates]
    machine, sizes = SuffixAutomaton(bodies), [len(b) for b in bodies]
    phrases = [(p.encode().split(), label) for p, label in PHRASES]
    seconds = {p[-1] for p, _ in phrases}

    def make():
        def one(data: bytes | None):
            w = words(data)
            places, labels = [], set()
            at = 0
            for last in seconds:
                if data and last in w:
                    at = -1
                    while True:
                        try:
                            at = w.index(last, at + 1)
                        except ValueError:
                            break
                        for p, label in phrases:
                            k = len(p)
                            if p[-1] == last and at >= k - 1 and w[at - k + 1:at + 1] == p:
                                places.append(at - k + 1)
                                labels.add(label)
            found = chains(machine.runs(w), machine, sizes)
            score = max([c[3] for c in found], default=0.0)
            covered = claimed([c for c in found if c[3] >= COVERED], sizes)
            every = labels | {names[c[0]] for c in covered}
            return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
                    ",".join(sorted(every)), min(1.0, score), ",".join(f"{names[t]}:{a}:{b}" for t, a, b, _ in covered))

        def batch(texts: list) -> list[pa.Array]:
            rows = list(zip(*[one(t) for t in texts], strict=True)) if texts else [[] for _ in range(8)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            return [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
        return batch

    return map_texts(df, keep, text, make, "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
                     "labels string, score double, spans string")
