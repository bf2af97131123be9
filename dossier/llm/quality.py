"""Quality as weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule says good, bad or nothing about a document. The votes of all documents are counted by vote pattern: at most 3^rules
patterns whatever the corpus size, so the counts may go to the driver. There expectation-maximisation estimates how often each
rule votes, and votes right, on good and on bad documents, and gives every pattern its posterior probability of good. That
posterior, not all-must-pass, keeps or rejects.

Null or empty text: no words, all counts 0, base_failed. Repeated rows each give a row and each count. Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, map_texts, stored

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"
_NO_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
_TAIL = bytes(range(0x80, 0xC0))
_PLAIN_WORD = re.compile(rb"""(?<![^\x20\x09-\x0d])["'(]*[A-Za-z\x80-\xff]['A-Za-z\x80-\xff-]*[.,;:!?)"']*(?![^\x20\x09-\x0d])""")
_LETTER_WORD = re.compile(rb"[A-Za-z\x80-\xff][^\x20\x09-\x0d]*")


def measure(text: bytes | None) -> tuple[int, ...]:
    """The five measures of the contract, then the words with a letter, those of letters and usual punctuation only, and the
    lines with a word."""
    if not text:
        return (0,) * 8
    words = text.split()
    chars = len(text.translate(None, SPACE + _TAIL))
    symbols = len(text.translate(None, _NO_SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeat += i + 3 - max(i, upto)
                upto = i + 3
    letters = len(_LETTER_WORD.findall(text))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat, letters, len(_PLAIN_WORD.findall(text)), len(lines)


def measures(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, the five measures, n_letter_words, n_plain_words and n_lines."""
    def make():
        def batch(texts: list) -> list[pa.Array]:
            rows = zip(*[measure(t) for t in texts], strict=True) if texts else [[] for _ in range(8)]
            return [pa.array(c, pa.int64()) for c in rows]
        return batch

    return map_texts(df, keep, text, make, ", ".join(f"{m} bigint" for m in [*MEASURES, "n_letter_words", "n_plain_words", "n_lines"]))


def base_failed():
    """Too few words, or more than half of them in repeated passages."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> dict[str, F.Column]:
    """1 good, -1 bad, 0 no opinion. Each pair of bounds leaves a band between them without a vote."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    def band(x, good, bad):
        return F.when(x <= good, 1).when(x >= bad, -1).otherwise(0)
    mean = F.col("word_chars") / words
    return {
        "length": F.when(F.col("n_words") < 50, -1).when(F.col("n_words") >= 80, 1).otherwise(0),
        "repeats": band(F.col("n_repeat_words") / words, 0.2, 0.5),
        "symbols": band(F.col("n_symbols") / words, 0.05, 0.2),
        "lines": band(F.col("n_dup_lines") / lines, 0.2, 0.5),
        "word_length": F.when((mean < 2.5) | (mean > 14), -1).when(mean.between(3, 11), 1).otherwise(0),
        "letters": F.when(F.col("n_letter_words") < 0.7 * words, -1).when(F.col("n_letter_words") >= 0.9 * words, 1).otherwise(0),
        "plain": F.when(F.col("n_plain_words") < 0.6 * words, -1).when(F.col("n_plain_words") >= 0.85 * words, 1).otherwise(0),
    }


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """The posterior of good for each vote pattern (rows of -1, 0, 1). The start doubts a document the more, the more rules call
    it bad; every rate keeps a pseudo-count, so an unseen vote is never impossible."""
    post = 0.9 * 0.3 ** (patterns == -1).sum(1)
    kinds = [(patterns == v).astype(float) for v in (-1, 0, 1)]
    prior_rate = {True: (0.15, 0.25, 0.6), False: (0.6, 0.25, 0.15)}
    for _ in range(rounds):
        rates, share = {}, {}
        for is_good, p in ((True, post), (False, 1 - post)):
            w = counts * p
            r = np.stack([w @ k + 2 * x for k, x in zip(kinds, prior_rate[is_good], strict=True)])
            rates[is_good], share[is_good] = r / r.sum(0), w.sum() + 1
        weight = np.log(rates[True]) - np.log(rates[False])
        weight[0], weight[2] = np.minimum(weight[0], 0), np.maximum(weight[2], 0)    # a vote never counts against what it says
        odds = sum(k @ x for k, x in zip(kinds, weight, strict=True)) + np.log(share[True]) - np.log(share[False])
        new = 1 / (1 + np.exp(np.clip(-odds, -700, 700)))
        if np.abs(new - post).max() < 1e-9:
            return new
        post = new
    raise RuntimeError("the posterior did not settle")


def posterior(measured: DataFrame) -> DataFrame:
    """(pattern, posterior): a table of at most 3^rules rows."""
    rules = votes()
    counted = measured.groupBy(*[v.cast("int").alias(k) for k, v in rules.items()]).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(*rules).collect()
    patterns = np.array([r[:len(rules)] for r in counted], dtype=int).reshape(-1, len(rules))
    post = expectation_maximisation(patterns, np.array([r[-1] for r in counted], dtype=float)) if counted else []
    rows = [("".join("-0+"[v + 1] for v in p), float(x)) for p, x in zip(patterns.tolist(), post, strict=True)]
    return measured.sparkSession.createDataFrame(rows, "pattern string, posterior double")


def judge(df: DataFrame, keep: list[str], text: str = "text", least: float = 0.5) -> DataFrame:
    """`keep`, the measures, pattern, posterior, base_failed, kept. The measures are stored once and read twice."""
    m = stored(measures(df, keep, text), "measures")
    pattern = F.concat(*[F.when(v > 0, "+").when(v < 0, "-").otherwise("0") for v in votes().values()])
    judged = m.withColumn("pattern", pattern).join(F.broadcast(posterior(m)), "pattern", "left")
    return judged.withColumn("base_failed", base_failed()) \
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= least))


def accept(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df that are kept, with df's own columns, whatever their names. Texts are measured twice rather than stored."""
    post = posterior(measures(df, [], text))
    pattern = F.concat(*[F.when(v > 0, "+").when(v < 0, "-").otherwise("0") for v in votes().values()])
    m = measures(df.select(F.struct("*").alias("row"), F.col(text).alias("body")), ["row"], "body")
    judged = m.withColumn("pattern", pattern).join(F.broadcast(post), "pattern")
    return judged.where(~base_failed() & (F.col("posterior") >= least)).select("row.*")
