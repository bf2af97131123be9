"""Secret scan: every rule in one automaton, every text in one pass over its bytes.

Rules are compiled once on the driver (`automaton`); the tables, a few hundred kilobytes, travel with the tasks. The pass only
notes where a rule is first complete; its own reversed and forward tables then give the leftmost start and the longest end. Per kind
matches do not overlap, and a match that fails its condition is dropped without looking again inside it.

Null or empty text: no spans. A null id stays null. Repeated rows each give a row. Other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import anchored, reach, searcher
from .common import map_texts, sha256

# The base rules of the contract, in its order: name, expression, least length of the whole match.
BASE = [
    ("assign", rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0),
    ("access", rb"AKIA[A-Z0-9]+", 20),
    ("hex", rb"[0-9a-f]{24,}", 24),          # leftmost runs of 24 or more are the runs that pass
]
# Everything before the value of an assignment; its longest reach from the start is where the value begins.
ASSIGN_HEAD = rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_VALUE = 6

# Public formats of further credentials, with the least length of a whole match.
MORE = [
    ("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    ("github", rb"gh[opsur]_[A-Za-z0-9]+", 40),
    ("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 15),
    ("google", rb"AIza[A-Za-z0-9_-]+", 39),
    ("stripe", rb"[rs]k_live_[A-Za-z0-9]+", 24),
    ("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
]
RULES = BASE + MORE


class Scanner:
    """Compiled rules. `spans(data)` gives (rule number, first byte, end byte) of all passing matches."""

    def __init__(self, rules: list[tuple[str, bytes, int]] = RULES):
        self.least = [n for _, _, n in rules]
        self.all = searcher([p for _, p, _ in rules])
        self.one = [anchored(p) for _, p, _ in rules]
        self.head = anchored(ASSIGN_HEAD)[0]
        self.assign = next((i for i, r in enumerate(rules) if r[0] == "assign"), -1)

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        table, accepting, state = self.all.table, self.all.accepting, self.all.start
        done, out = {}, []
        for i, c in enumerate(data.translate(self.all.classes)):
            state = table[state + c]
            if state >= accepting:
                for r in self.all.rules[state]:
                    if i >= done.get(r, 0):
                        self._take(r, i, data, done, out)
        return out

    def _take(self, r: int, last: int, data: bytes, done: dict, out: list) -> None:
        ahead, back = self.one[r]
        start = reach(back, data, last, done.get(r, 0) - 1)
        if start is None:
            return
        end = reach(ahead, data, start, len(data))
        done[r] = end
        if end - start < self.least[r]:
            return
        if r == self.assign and end - reach(self.head, data, start, end) < ASSIGN_VALUE:
            return
        out.append((r, start, end))


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    at, chars, seen = 0, 0, {}
    for b in sorted({x for _, s, e in spans for x in (s, e)}):
        chars += len(data[at:b].decode("utf-8", "replace"))
        at, seen[b] = b, chars
    return [(r, seen[s], seen[e]) for r, s, e in spans]


def scan(df: DataFrame, keep: list[str], text: str = "text", rules: list[tuple[str, bytes, int]] = RULES, base: int = len(BASE)) -> DataFrame:
    """`keep`, n_<rule> for the first `base` rules, base_sha256 and spans (kind:start:end by start, then in the order of rules)."""
    compiled, names = Scanner(rules), [r[0] for r in rules]

    def make():
        def batch(texts: list) -> list[pa.Array]:
            counts, base_digest, spans = [[] for _ in range(base)], [], []
            for t in texts:
                found = sorted(compiled.spans(t), key=lambda x: (x[1], x[0])) if t else []
                found = code_points(t, found) if found else found
                for r in range(base):
                    counts[r].append(sum(x[0] == r for x in found))
                text_of = lambda xs: ",".join(f"{names[r]}:{s}:{e}" for r, s, e in xs)
                base_digest.append(sha256(text_of([x for x in found if x[0] < base])))
                spans.append(text_of(found))
            return [*[pa.array(c, pa.int64()) for c in counts], pa.array(base_digest, pa.string()), pa.array(spans, pa.string())]
        return batch

    schema = ", ".join(f"n_{n} bigint" for n in names[:base]) + ", base_sha256 string, spans string"
    return map_texts(df, keep, text, make, schema)
