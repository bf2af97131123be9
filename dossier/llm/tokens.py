"""Token counts by rank-synchronous merging.

The distinct pre-tokens of a batch are held as one ragged array of symbol ids. In every round each sequence finds its pair of
lowest rank and all sequences merge theirs at once; finished sequences leave the array. What survives is counted and summed
over each text's pre-tokens. The vocabulary file is read on the driver and its merge table travels with the tasks; normalising
and splitting into pre-tokens are the tokenizer library's own.

Null or empty text: 0 bytes, 0 tokens. Repeated rows each give a row. Other columns are not read. Texts are never cut.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts


class Merges:
    """Merge ranks as sorted arrays. `count` gives the number of symbols that survive in each pre-token."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, merges = model["vocab"], model["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        suffix = model.get("end_of_word_suffix") or ""
        self.suffix = suffix
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.arange(len(keys))[order], made[order]
        chars = {k: v for k, v in vocab.items() if len(k) == 1}
        most = max(map(ord, chars)) + 1
        self.inner = np.full(most, -1, dtype=np.int64)
        self.final = np.full(most, -1, dtype=np.int64)
        for c, i in chars.items():
            self.inner[ord(c)] = i
            self.final[ord(c)] = vocab.get(c + suffix, -1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the merge table, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def count(self, tokens: list[str]) -> np.ndarray:
        """The number of tokens of each (non-empty) pre-token, given in the vocabulary's byte characters."""
        out = np.ones(len(tokens), dtype=np.int64)
        if not tokens:
            return out
        sizes = np.array([len(t) for t in tokens])
        codes = np.frombuffer("".join(tokens).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        ids = self.inner[codes]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.final[codes[ends]]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        far = len(self.keys)
        # rank of the pair that begins at each symbol; none across a sequence's end
        at = np.full(len(ids), -1)
        at[:-1] = self._ranks(ids[:-1], ids[1:])
        at[ends] = -1
        while True:
            rank = np.where(at >= 0, self.rank[at], far)
            begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(rank, begins)
            live = lowest < far
            if not live.all():      # finished sequences leave
                counts = np.diff(np.concatenate((begins, [len(ids)])))
                out[owner[begins[~live]]] = counts[~live]
                keep = np.repeat(live, counts)
                ids, owner, at, rank = ids[keep], owner[keep], at[keep], rank[keep]
                if not len(ids):
                    return out
                lowest, begins = lowest[live], np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            counts = np.diff(np.concatenate((begins, [len(ids)])))
            hit = rank == np.repeat(lowest, counts)
            # of overlapping hits (equal symbols in a row) every second one merges, from the left
            place = np.flatnonzero(hit)
            first = np.concatenate(([True], np.diff(place) > 1))
            run = place[first][np.cumsum(first) - 1]
            place = place[(place - run) % 2 == 0]
            ids[place] = self.made[at[place]]
            stay = np.ones(len(ids), dtype=bool)
            stay[place + 1] = False
            where = np.cumsum(stay) - 1
            ids, owner, at = ids[stay], owner[stay], at[stay]
            new = where[place]
            last = np.concatenate((owner[1:] != owner[:-1], [True]))
            for p in (new, new[new > 0] - 1):     # pairs that begin at a merged symbol or just before it
                at[p] = self._ranks(ids[p], ids[np.minimum(p + 1, len(ids) - 1)])
            at[last] = -1


# The byte characters of byte-level vocabularies: printable bytes stand for themselves, the others for 256 onwards.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in _SELF} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_SELF))}
# Beyond this plane the two libraries know different versions of Unicode; texts with such characters are split by the tokenizer's.
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
# Sizes of distinct pre-tokens that a task remembers.
REMEMBERED = 400_000


class Splitter:
    """A text's pre-tokens in vocabulary characters. A plain split by an expression runs in the regex module; everything else in
    the tokenizer library."""

    def __init__(self, shell: str):
        import regex
        from tokenizers import Tokenizer

        rest, spec = Tokenizer.from_str(shell), json.loads(shell)
        self.normal, self.split = rest.normalizer, rest.pre_tokenizer
        self.find = None
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [p["type"] for p in parts] == ["Split", "ByteLevel"] and "Regex" in parts[0]["pattern"] and parts[0]["invert"] \
                and parts[0]["behavior"] == "Removed" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
            self.find = regex.compile(parts[0]["pattern"]["Regex"]).findall

    def __call__(self, text: str) -> tuple[list[str], bool]:
        """The pre-tokens, and whether they are still text rather than vocabulary characters."""
        text = self.normal.normalize_str(text) if self.normal else text
        if self.find and not _BEYOND.search(text):
            return self.find(text), True
        return [t for t, _ in self.split.pre_tokenize_str(text)], False


def count(df: DataFrame, keep: list[str], vocabulary: str, text: str = "text") -> DataFrame:
    """`keep`, n_bytes, n_tokens. `vocabulary` is the path of a tokenizers file with a BPE model, read on the driver."""
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    spec = json.loads(content)
    merges = Merges(spec)
    special = [t["content"] for t in spec["added_tokens"]]
    # the library's normaliser and splitter, without the model's tables
    shell = json.dumps(spec | {"added_tokens": [], "model": {**spec["model"], "vocab": {}, "merges": []}})

    def make():
        split = Splitter(shell)
        cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        sizes: dict[bool, dict[str, int]] = {True: {}, False: {}}

        def batch(texts: list) -> list[pa.Array]:
            for kind in sizes:
                if len(sizes[kind]) > REMEMBERED:
                    sizes[kind] = {}
            totals, found = [0] * len(texts), []
            for i, raw in enumerate(texts):
                if not raw:
                    continue
                whole = raw.decode("utf-8", "replace")
                parts = cut.split(whole) if cut else [whole]
                totals[i] = len(parts) - 1
                found += [(i, *split(p)) for p in parts if p]
            for as_text in sizes:
                new = list({t for _, tokens, kind in found if kind == as_text for t in tokens if t not in sizes[as_text]})
                chars = [t.encode().decode("latin-1").translate(BYTE_CHARS) for t in new] if as_text else new
                sizes[as_text].update(zip(new, merges.count(chars).tolist(), strict=True))
            for i, tokens, kind in found:
                totals[i] += sum(map(sizes[kind].__getitem__, tokens))
            return [pa.array([len(t) if t else 0 for t in texts], pa.int64()), pa.array(totals, pa.int64())]
        return batch

    return map_texts(df, keep, text, make, "n_bytes bigint, n_tokens bigint")


def over(df: DataFrame, limit: int) -> DataFrame:
    return df.withColumn("over_limit", F.col("n_tokens") > limit)
