"""Registered queries against their SQL, and properties of the plans."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from dossier.operators import cards as C
from dossier.operators import parse as P
from dossier.operators import rank as R
from dossier.functions import text as T

SF = "/root/testdata/sf0.001"
QUICK = ["bm25_topk", "tfidf_lines_topk", "line_blocks", "digest_bound", "timeline_merge", "exact_dup", "asof_value", "supersede_by_date", "set_validator"]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    status, note = check.compare(spark, check.connect(SF), name, SF)
    assert status == "ok", note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_plan_shares_its_exchange_and_limits_early(spark):
    d = spark.range(50).select(F.col("id").alias("doc"), F.lit("heron bees tide").alias("text"))
    q = spark.createDataFrame([(1, "heron tide")], "qid long, question string")
    p = R.bm25(d, q, 3)
    p.collect()
    final = _plan(p)
    assert "WindowGroupLimit" in final and "CartesianProduct" not in final


def test_card_contexts_keep_the_budget_and_hop(spark):
    n_blocks = 40
    chunks = [(i, f"n/{i}.md", 0, f"2026-01-{i % 28 + 1:02d}", None, ("Heron mentions Bees. " if i % 4 == 0 else "Heron only. ") + "word " * (i * 3)) for i in range(n_blocks)]
    chunks += [(100, "n/bees.md", 0, "2026-02-01", None, "Bees swarm in May.")]
    ch = spark.createDataFrame(chunks, "chunk long, path string, no int, date string, heading string, text string").withColumn("text", T.strip("text")) \
        .withColumn("rendered", P.rendered("path", "date", "text")).withColumn("n_tokens", T.tokens("rendered"))
    ent = spark.createDataFrame([("heron", "Heron", "Heron", "project", [("Heron", True)], []), ("bees", "Bees", "Bees", "topic", [("Bees", True)], []),
                                 ("owl", "Owl", "Owl", "topic", [("Owl", True)], [])],
                                "slug string, name string, display string, kind string, aliases array<struct<text:string,cs:boolean>>, notes array<string>")
    tl = [("heron", f"{i:010x}", c[3], c[1], "", f"- {c[3]} · [[n/{i}|{i}]] · {i}" + (" (defining note)" if i == 7 else "") + f" <!--k:{i:010x}-->", True, False)
          for i, c in enumerate(chunks[:n_blocks])]
    tl += [("bees", "f" * 10, "2026-02-01", "n/bees.md", "", f"- 2026-02-01 · [[n/bees|bees]] · bees <!--k:{'f' * 10}-->", True, False)]
    t = spark.createDataFrame(tl, "slug string, k string, when string, rel string, block string, line string, in_vault boolean, gone boolean")
    index = C.build_index(t, ent, ch)
    q = spark.createDataFrame([("a", "What about Heron?"), ("b", "When do insects swarm in May?"), ("c", "Is there an Owl?")], "qid string, question string")
    for budget in (120, 600, 3000):
        rows = C.contexts(q, index, budget).orderBy("qid", "pos").collect()
        for qid in "abc":
            assert sum(r["cost"] for r in rows if r["qid"] == qid) <= budget + 1
        a = [r for r in rows if r["qid"] == "a"]
        assert a[0]["what"] == "section" and a[0]["text"].startswith("[cards/project/heron.md] Heron (project), 40 entries, newest first")
        assert len({r["item"] for r in a if r["what"] == "block"}) == sum(r["what"] == "block" for r in a)
        if budget >= 600:
            assert next(r["item"] for r in a if r["what"] == "block") == "7"           # the defining note comes first
            assert any(r["slug"] == "bees" and r["what"] == "section" for r in a)       # one hop
            assert any(r["item"] == "100" for r in a)
        assert [r["item"] for r in rows if r["qid"] == "b"][0] == "100"                  # no card named: BM25
        assert all(r["what"] == "bm25" for r in rows if r["qid"] in "bc")
    ctx = C.context_text(C.contexts(q, index, 600)).collect()
    assert all(T_len(r["context"]) <= 600 for r in ctx)


def T_len(text):
    return (len(text) + 3) // 4
