"""Retrievers under one signature: (chunks, questions, budget, **extra) to (qid, pos, chunk text).

chunks(chunk, path, no, date, heading, text, rendered, n_tokens); questions(qid, question).
Add one with `register`.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from . import budget as Bd
from . import cards as C
from . import evalkit as E
from . import rank as R

Retriever = Callable[..., DataFrame]
RETRIEVERS: dict[str, Retriever] = {}


def register(name: str) -> Callable[[Retriever], Retriever]:
    def add(fn: Retriever) -> Retriever:
        RETRIEVERS[name] = fn
        return fn
    return add


def _docs(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk").alias("doc"), "text", "date")


def pack(scored: DataFrame, chunks: DataFrame, order: list, budget: int) -> DataFrame:
    """Rank order to texts within the budget."""
    r = scored.join(chunks.select(F.col("chunk").alias("doc"), (F.col("n_tokens") + 1).alias("cost")), "doc")
    cand = Bd.bounded_candidates(r, "qid", order, "cost", budget, 5)
    cand = cand.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    f = Bd.fill(cand, "qid", "rank", "cost", "doc", budget, 5)
    return f.join(chunks.select(F.col("chunk").alias("doc"), F.col("rendered").alias("text")), "doc").select("qid", "pos", "text")


@register("none")
def none(chunks, questions, budget, **_):
    return questions.select("qid", F.lit(0).alias("pos"), F.lit("").alias("text"))


@register("grep")
def grep(chunks, questions, budget, **_):
    d = _docs(chunks)
    s = R.grep(d, questions, None).join(d.select("doc", F.col("date").alias("day")), "doc")
    return pack(s, chunks, [F.col("score").desc(), F.col("day").desc(), F.col("doc")], budget)


@register("bm25")
def bm25(chunks, questions, budget, **_):
    return pack(R.bm25(_docs(chunks), questions, None), chunks, [F.col("score").desc(), F.col("doc").desc()], budget)


@register("dense")
def dense(chunks, questions, budget, vectors=None, query_vectors=None, **_):
    """vectors(doc, embedding) and query_vectors(qid, embedding) come from a provider of the caller's."""
    return pack(R.dense(vectors, query_vectors, X.DENSE_DEPTH), chunks, [F.col("rank")], budget)


@register("hybrid")
def hybrid(chunks, questions, budget, vectors=None, query_vectors=None, **_):
    a = R.dense(vectors, query_vectors, X.FUSE_DEPTH)
    b = R.bm25(_docs(chunks), questions, X.FUSE_DEPTH)
    return pack(R.rrf([a, b], X.FUSE_DEPTH, first_rank=0), chunks, [F.col("rank")], budget)


def embed(texts: DataFrame, provider: Callable[[list[str]], list[list[float]]], stored: DataFrame | None = None, batch: int = 32) -> DataFrame:
    """texts(doc, text) to vectors(doc, sha, embedding) with a provider called in the tasks, `batch` texts at
    a time. Texts whose digest is in stored(sha, embedding) are not sent again; equal texts are sent once."""
    t = texts.select("doc", "text", F.sha1("text").alias("sha"))
    todo = t.groupBy("sha").agg(F.first("text").alias("text"))
    if stored is not None:
        todo = todo.join(stored.select("sha").distinct(), "sha", "left_anti")

    def run(parts):
        for pdf in parts:
            out = []
            for i in range(0, len(pdf), batch):
                out += provider(list(pdf["text"].iloc[i:i + batch]))
            yield pd.DataFrame({"sha": pdf["sha"], "embedding": out})

    fresh = todo.mapInPandas(run, "sha string, embedding array<float>")
    known = fresh if stored is None else fresh.unionByName(stored.select("sha", "embedding"))
    return t.select("doc", "sha").join(known, "sha").select("doc", "sha", "embedding")


@register("memory")
def memory(chunks, questions, budget, memory_text="", **_):
    """The start of a memory file: four characters per token of budget."""
    return questions.select("qid", F.lit(0).alias("pos"), F.substring(F.lit(memory_text), 1, budget * 4).alias("text"))


@register("cards")
def cards(chunks, questions, budget, index: C.CardIndex | None = None, **_):
    return C.contexts(questions, index, budget).select("qid", "pos", "text")


@register("cards-v1")
def cards_v1(chunks, questions, budget, index: C.CardIndex | None = None, **_):
    return C.contexts(questions, index, budget, match=False).select("qid", "pos", "text")


@register("oracle")
def oracle(chunks, questions, budget, gold=None, facts=None, block_dirs=(), **_):
    """The blocks that hold the planted facts, newest first."""
    o = E.oracle_blocks(gold, facts, chunks, block_dirs).withColumnRenamed("chunk", "doc")
    o = o.join(chunks.select(F.col("chunk").alias("doc"), "date"), "doc")
    return pack(o, chunks, [F.col("date").desc(), F.col("doc")], budget)


def contexts(name: str, chunks: DataFrame, questions: DataFrame, budget: int, **extra) -> DataFrame:
    """(qid, context, ctx_key, ctx_tokens) of a registered retriever."""
    c = C.context_text(RETRIEVERS[name](chunks, questions, budget, **extra))
    return c.withColumn("ctx_tokens", T.tokens("context"))


def weekly_batches(chunks: DataFrame, undated_prefix: str = "", start: str = "") -> DataFrame:
    """(week, path, date, text): what a weekly memory writer reads. Notes under `undated_prefix` count
    to the first week."""
    day = F.when(F.col("path").startswith(undated_prefix), F.lit(start)).otherwise(F.col("date")) if undated_prefix else F.col("date")
    g = chunks.groupBy("path").agg(F.min(day).alias("date"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("no", "text"))), lambda x: x.text), "\n").alias("text"))   # chunks of one note
    return g.select(T.iso_week(F.col("date").cast("date")).alias("week"), "path", "date", "text")
