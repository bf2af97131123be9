"""Question terms in text: one pass of an automaton over all terms, scored and cut to the best where the text lies.

The terms of a batch of questions travel with the task, within a bound that callers check (`rank._QuerySide.fits`); each text is
read once, and what leaves the task are the k best documents per question and batch, so nothing of the text is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

class Terms:
    """Distinct terms and, for each, the questions that ask for it, as two flat arrays."""

    def __init__(self, pairs: pd.DataFrame):
        ids = pd.Categorical(pairs["qid"])
        self.qids = ids.categories.to_numpy()
        words = pd.Categorical(pairs["term"])
        self.words = list(words.categories)
        order = np.argsort(words.codes, kind="stable")
        self.questions = ids.codes[order].astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(words.codes, minlength=len(self.words))))).astype(np.int64)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.words:
            return None
        a = ahocorasick.Automaton()
        for i, w in enumerate(self.words):
            a.add_word(w, i)
        a.make_automaton()
        return a

    def names(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words)}

    def asking(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places of found terms: each asking question, and which place it belongs to."""
        n = self.starts[found + 1] - self.starts[found]
        at = np.repeat(np.arange(len(found)), n)
        first = np.cumsum(n) - n
        return self.questions[self.starts[found][at] + np.arange(len(at)) - first[at]], at


def present(automaton, text: str | None) -> dict[int, int]:
    """Terms that occur in the text."""
    return dict.fromkeys((i for _, i in automaton.iter(text)), 1) if text else {}


def lines_with(automaton, text: str | None) -> dict[int, int]:
    """Terms and the number of lines of the text that contain them."""
    out: dict[int, int] = {}
    for line in (text or "").split("\n"):
        for i in {i for _, i in automaton.iter(line)} if line else ():
            out[i] = out.get(i, 0) + 1
    return out


def tokens(names: dict[str, int], words: str | None) -> dict[int, int]:
    """Terms among the words of a text, separated by blanks, and how often each occurs."""
    return {names[w]: c for w, c in Counter(words.split(" ")).items() if w in names} if words else {}


MOST_PAIRS = 500_000    # pairs of a match and an asking question that a task holds at once, besides those of one text
MOST_KEPT = 200_000     # rows kept from the texts of a batch before they are cut again


def _arrays(rows: list[int], found: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(f) for f in found], dtype=np.int64)
    terms = np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))
    counts = np.fromiter((c for f in found for c in f.values()), np.int64, int(sizes.sum()))
    return np.repeat(np.array(rows, dtype=np.int64), sizes), terms, counts


def _matches(texts, terms: Terms, finder, count) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, term and count of every match in the texts of a batch, in pieces of whole texts that `MOST_PAIRS` bounds."""
    asked, rows, found, pairs = np.diff(terms.starts), [], [], 0
    for i, text in enumerate(texts):
        f = count(finder, text)
        if not f:
            continue
        n = int(asked[np.fromiter(f, np.int64, len(f))].sum())
        if found and pairs + n > MOST_PAIRS:
            yield _arrays(rows, found)
            rows, found, pairs = [], [], 0
        rows.append(i)
        found.append(f)
        pairs += n
    if found:
        yield _arrays(rows, found)


def _finder(terms: Terms, count: Callable):
    return terms.names() if count is tokens else terms.automaton()


DOCUMENTS, LENGTHS = -1, -2     # in place of a term: the number of documents, and the sum of their lengths


def frequencies(docs: DataFrame, terms: Terms, count: Callable = present) -> DataFrame:
    """(corpus, i, df): documents of each corpus that hold term i, all documents, and their lengths. docs(corpus, length, body)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder, m = _finder(terms, count), len(terms.words)
        for pdf in batches:
            corpus = pd.Categorical(pdf["corpus"])
            names = corpus.categories.to_numpy()
            for row, term, _ in _matches(pdf["body"], terms, finder, count) if finder else ():
                key, n = np.unique(corpus.codes[row].astype(np.int64) * m + term, return_counts=True)
                yield pd.DataFrame({"corpus": names[key // m], "i": key % m, "df": n})
            for i, weight in ((DOCUMENTS, None), (LENGTHS, pdf["length"])):
                yield pd.DataFrame({"corpus": names, "i": i, "df": np.bincount(corpus.codes, weight, len(names)).astype(np.int64)})

    d = docs.select("corpus", "length", "body")
    return d.mapInPandas(run, f"corpus {dict(d.dtypes)['corpus']}, i bigint, df bigint").groupBy("corpus", "i").agg(F.sum("df").alias("df"))


def first_k(k: int | None) -> Callable:
    """Keeps the k best of each question."""
    return lambda ranked: ranked if k is None else ranked[ranked.groupby("_q").cumcount() < k]


def fitting(cost: str, budget: int) -> Callable:
    """Keeps what a budget could ever take: of one cost at most budget / cost of each question, the best ones."""
    def keep(ranked: pd.DataFrame) -> pd.DataFrame:
        r = ranked[(ranked[cost] > 0) & (ranked[cost] <= budget)]
        return r[(r.groupby(["_q", cost]).cumcount() + 1) * r[cost] <= budget]

    return keep


def best(docs: DataFrame, terms: Terms, count: Callable, weigh: Callable, order: list[tuple[str, bool]], keep: Callable, digits: int,
         carry: tuple[str, ...] = ()) -> DataFrame:
    """(qid, order and carry columns, score): documents with a term of a question, in each batch cut by `keep`, which sees them best
    first: by score (rounded), then by `order`, pairs of a column and whether it descends. docs has `body` (text or words) besides;
    weigh(pdf, row, term, count) gives each match's share of the score."""
    names = [c for c, _ in order] + list(carry)
    types = dict(docs.dtypes)
    columns, ascending = ["_q", "_s", *[c for c, _ in order]], [True, False, *[not down for _, down in order]]

    def ranked(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return keep(pd.concat(parts).sort_values(columns, ascending=ascending, kind="stable"))

    def shown(out: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"qid": terms.qids[out["_q"]], **{c: out[c] for c in names}, "score": out["_s"]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _finder(terms, count)
        for pdf in batches if finder else ():
            held, n = [], 0
            for row, term, counts in _matches(pdf["body"], terms, finder, count):
                question, at = terms.asking(term)
                key, place = np.unique(question * len(pdf) + row[at], return_inverse=True)
                score = np.round(np.bincount(place, weights=np.asarray(weigh(pdf, row, term, counts), dtype=float)[at], minlength=len(key)), digits)
                held.append(ranked([pd.DataFrame({"_q": key // len(pdf), "_s": score, **{c: pdf[c].to_numpy()[key % len(pdf)] for c in names}})]))
                n += len(held[-1])
                if n > MOST_KEPT:
                    yield shown(ranked(held))
                    held, n = [], 0
            if held:
                yield shown(ranked(held))

    qtype = "string" if terms.qids.dtype == object else "bigint"
    return docs.mapInPandas(run, f"qid {qtype}, " + ", ".join(f"{c} {types[c]}" for c in names) + ", score double")


def holding(docs: DataFrame, texts: DataFrame, most: int = 16_000_000) -> DataFrame:
    """(qid, doc) of documents that hold a text verbatim. docs(doc, text), texts(qid, question): texts of up to `most` characters
    travel with one pass over the documents; more take more passes. Empty texts are held nowhere."""
    t = texts.where(F.length("question") > 0).select("qid", F.col("question").alias("term"))
    passes = max(1, -(-(t.agg(F.sum(F.length("term"))).first()[0] or 0) // most))
    types, out = (dict(texts.dtypes)["qid"], dict(docs.dtypes)["doc"]), None
    for i in range(passes):
        part = Terms(t.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i).toPandas())
        found = best(docs.select("doc", F.col("text").alias("body")), part, present, lambda pdf, row, term, c: c, [("doc", False)], first_k(None), 0)
        found = found.select(F.col("qid").cast(types[0]).alias("qid"), "doc")
        out = found if out is None else out.unionByName(found)
    return out
