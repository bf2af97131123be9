"""Periodic runs of words: a suffix automaton whose link tree is walked by link-cut access.

A run is a maximal stretch of words of smallest period q with length >= max(6, 4 * q). Words are appended one by one. The
access to a prefix's state walks its suffix links up to the root and recolours that path with the prefix's end; the path falls
into segments of one last end each, and if the last end j of a segment whose longest suffix has b words is q = i - j <= b words
back, the words from j - b + 1 to i are a square of period q that no earlier word extends. The same start and period at later
ends extends it to the run. Splay trees hold one colour each, so the number of segments and steps is logarithmic per word.

A run of period q ends in at least 3 * q - 2 places whose three words occurred at most q words before, so stretches of places
without that are left out first (an exact bound: equal words have equal hashes); the automaton sees only what is left, plus the
words such a run could reach back to. Working memory is in proportion to one text.

Null or empty text, or text without words: no runs, nothing collapsed. Every row is judged by itself: repeated rows and rows
that share an id give equal results, null ids stay null, other columns are not read. An empty table gives an empty table.
Ties for the greatest exponent go to the smallest start, then the smallest period.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, WORD, map_texts, mix

LEAST, REPEATS = 6, 4       # a run has at least LEAST words and REPEATS periods
SCHEMA = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def automaton(seq: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of seq: suffix link and longest length of every state (0 is none, 1 the root), and the state of every
    prefix."""
    link, length, step, at = [0, 0], [-1, 0], [{}, {}], []
    last = 1
    for c in seq:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        at.append(new)
        p = last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                while p and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return link, length, at


class Paths:
    """Preferred paths of a fixed tree as splay trees in order of depth; the root of each splay tree holds its path's colour."""

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up = list(parent)      # parent in the splay tree, or the tree node above the path
        self.near, self.far, self.colour = [0] * n, [0] * n, [-1] * n

    def _top(self, x: int) -> bool:
        p = self.up[x]
        return not p or (self.near[p] != x and self.far[p] != x)

    def _rotate(self, x: int) -> None:
        """x takes its parent's place, and its colour if that was the root."""
        up, near, far = self.up, self.near, self.far
        p = up[x]
        g = up[p]
        if g and near[g] == p:
            near[g] = x
        elif g and far[g] == p:
            far[g] = x
        else:
            self.colour[x] = self.colour[p]
        if near[p] == x:
            moved = near[p] = far[x]
            far[x] = p
        else:
            moved = far[p] = near[x]
            near[x] = p
        if moved:
            up[moved] = p
        up[p], up[x] = x, g

    def splay(self, x: int) -> None:
        """x becomes the root of its splay tree."""
        up, near, top = self.up, self.near, self._top
        while not top(x):
            p = up[x]
            if not top(p):
                self._rotate(p if (near[p] == x) == (near[up[p]] == p) else x)
            self._rotate(x)

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Recolours the path from x to the root. Returns (deepest state, colour before) of every segment, deepest first."""
        seen, below = [], 0
        far, tint, up = self.far, self.colour, self.up
        while x:
            self.splay(x)
            before = tint[x]
            seen.append((x, before))
            if far[x]:
                tint[far[x]] = before
            far[x] = below
            below, x = x, up[x]
        tint[below] = colour
        return seen


def squares(seq: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) -> last word, of all runs of seq."""
    link, length, at = automaton(seq)
    paths, out = Paths(link), {}
    for i, state in enumerate(at):
        for deepest, j in paths.access(state, i):
            q, b = i - j, length[deepest]
            if j >= 0 and (REPEATS - 1) * q <= b and b + q >= LEAST:
                out[j - b + 1, q] = i
    return out


def suspects(ids: np.ndarray) -> Iterable[tuple[int, int]]:
    """Disjoint ranges of places [from, to) that hold every run whole, with a word more on either side."""
    n = len(ids)
    if n < LEAST:
        return []
    w = ids.astype(U)
    tri = mix(mix(mix(w[:-2] + U(1)) + w[1:-1]) + w[2:])
    order = np.argsort(tri, kind="stable")
    back = np.zeros(n - 2, np.int64)
    same = tri[order[1:]] == tri[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]      # words since the same three words, 0 if none
    ok = back > 0
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        lo, hi = edge[0::2], edge[1::2]
        reach = (hi - lo + 2) // (REPEATS - 1)                  # no run of a longer period ends here
        limit = np.where(hi - lo >= LEAST - 3, reach, 0)
        left = ok.copy()
        left[ok] = back[ok] <= np.repeat(limit, hi - lo)
        before, after = int(ok.sum()), int(left.sum())
        ok = left
        if not after:
            return []
        if 8 * after > 7 * before:                              # what stays too long is only work, never a wrong result
            break
    edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
    lo, hi = edge[0::2], edge[1::2]
    lo, hi = np.maximum(lo - (hi - lo + 2) // (REPEATS - 1) - 1, 0), np.minimum(hi + 3, n)
    out = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    out = []
    for a, b in suspects(ids):
        out.extend((a + s, e - s + 1, q) for (s, q), e in squares(ids[a:b].tolist()).items())
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g)


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def scan(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_runs, the run of greatest length / period (start, length, period, exponent_milli; null without runs), all runs
    by start and period, and the text with every run cut to its first period."""
    def make():
        def batch(texts: list) -> list[pa.Array]:
            best, runs, texts_out = [], [], []
            for t in texts:
                words = t.split() if t else []
                found = runs_of(words)
                best.append(_greatest(found) or (None, None, None))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts_out.append(collapse(words, found))
            column = lambda k: pa.array([b[k] for b in best], pa.int64())
            milli = pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64())
            return [pa.array([len(r) for r in runs], pa.int64()), column(0), column(1), column(2), milli, pa.array(runs, _RUN),
                    pa.array(texts_out, pa.binary()).cast(pa.string())]
        return batch

    return map_texts(df, keep, text, make, SCHEMA)


def planted(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text: about one document in ten repeats its words from some place on (by the crc32 of its id); a null id repeats nothing."""
    d = df.select(F.col(id_), F.col(text).cast("string").alias("text"), F.crc32(F.col(id_).cast("string")).alias("_h"))
    chosen = F.col("_h") % 10 == 0
    d = d.select(id_, "text", F.floor(F.col("_h") / 10).cast("long").alias("_g"),
                 F.when(chosen, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)).alias("_w"))
    d = d.withColumn("_n", F.coalesce(F.size("_w"), F.lit(0)))
    d = d.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    d = d.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    again = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_w", place(i).cast("int")))
    return d.select(id_, F.when(F.col("_n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digests(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """scan() with the runs and the collapsed text as SHA-256."""
    s = scan(df, keep, text)
    line = lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return s.select(*keep, "n_runs", "start", "length", "period", "exponent_milli", F.sha2(listed, 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256"))
