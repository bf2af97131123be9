"""Rankings of documents for every benchmark question, their fusion, packing and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget as Bd
from ..operators import evalkit as E
from ..operators import parse as P
from ..operators import rank as R
from ..operators import termscan as A
from ..sources.tables import notes, questions, table
from . import sqltext as Q
from .registry import query


def docs(spark, sf) -> DataFrame:
    return notes(spark, sf).select(F.col("doc_id").alias("doc"), "text", "date", F.col("source").alias("corpus"), "rel")


def passages(docs_: DataFrame, questions_: DataFrame) -> DataFrame:
    """(qid, doc): documents that hold a question's text verbatim."""
    return A.holding(docs_, questions_)


def ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {Q.grep('r', 10)} select qid, doc, score, rank from r")
def grep_topk(spark, sf):
    return ranked(R.grep(docs(spark, sf), questions(spark, sf), 10))


@query(f"with {Q.tfidf('r', 5)} select qid, doc, score, rank from r")
def tfidf_lines_topk(spark, sf):
    return ranked(R.tfidf_lines(docs(spark, sf), questions(spark, sf), 5))


@query(f"with {Q.bm25('r', 10)} select qid, doc, score, rank from r")
def bm25_topk(spark, sf):
    return ranked(R.bm25(docs(spark, sf), questions(spark, sf), 10))


_FTS_TERMS = lambda x: f"list_distinct(flatten(list_transform({Q.eval_terms(x)}, lambda t: regexp_extract_all(t, '[a-z0-9]+'))))"
_FTS_WORDS = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


@query(f"with {Q.bm25('r', 10, _FTS_TERMS, _FTS_WORDS)} select qid, doc, score, rank from r")
def fts_topk(spark, sf):
    return ranked(R.fts(docs(spark, sf), questions(spark, sf), 10))


@query("""
with c as (select label as qid, list(m order by i) as q from (
  select label, i, avg(x) as m from (select label, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all) group by label),
s as (select c.qid, e.vec_id as doc, round(list_cosine_similarity(cast(e.embedding as double[]), c.q), 6) as score from embeddings e cross join c)
select cast(qid as bigint) as qid, doc, score, rank from (select *, row_number() over (partition by qid order by score desc, doc) as rank from s) where rank <= 200""")
def dense_cosine_topk(spark, sf):
    """Every vector against the mean vector of each label."""
    e = table(spark, sf, "embeddings")
    mean = e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")) \
        .groupBy("label", "i").agg(F.avg("x").alias("m"))
    q = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("embedding"))
    q = q.select(F.col("label").cast("long").alias("qid"), "embedding")
    return ranked(R.dense(e.select(F.col("vec_id").alias("doc"), "embedding"), q))


_TWO = f"{Q.bm25('a', 300)}, {Q.tfidf('b', 300)}"


@query(f"""with {_TWO},
u as (select qid, doc, 1.0 / (59 + rank) as s, 0 as l, rank from b union all select qid, doc, 1.0 / (59 + rank), 1, rank from a),
f as (select qid, doc, round(sum(s), 9) as score, min(l * 1000 + rank) as entered from u group by all)
select qid, doc, score, rank from (select *, row_number() over (partition by qid order by score desc, entered) as rank from f) where rank <= 600""")
def rrf_zero_based(spark, sf):
    d, q = docs(spark, sf), questions(spark, sf)
    return ranked(R.rrf([R.tfidf_lines(d, q, 300), R.bm25(d, q, 300)], 300, first_rank=0))


@query(f"""with {Q.bm25('a', 10)}, {Q.tfidf('b', 10)},
u as (select qid, doc, 1.0 / (60 + rank) as s from a union all select qid, doc, 1.0 / (60 + rank) from b),
f as (select qid, doc, round(sum(s), 9) as score from u group by all)
select qid, doc, score, rank from (select *, row_number() over (partition by qid order by score desc, doc) as rank from f) where rank <= 20""")
def rrf_one_based(spark, sf):
    d, q = docs(spark, sf), questions(spark, sf)
    return ranked(R.rrf([R.tfidf_lines(d, q, 10), R.bm25(d, q, 10)], 10, first_rank=1))


_COST = "cast((length('[' || source || '/' || doc_id || '.md | ' || " + Q.DAY + " || ']' || chr(10) || regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) + 3) // 4 + 1 as bigint)"


@query(f"""with recursive {Q.bm25('r', None)},
c as (select qid, doc, cost, row_number() over (partition by qid order by rank) as i
      from r join (select doc_id as doc, {_COST} as cost from documents) using (doc) where cost <= 4000),
w as (select qid, 0 as i, cast(0 as bigint) as used, cast(null as bigint) as doc, false as took from (select distinct qid from c)
      union all select c.qid, c.i, case when w.used + c.cost <= 4000 then w.used + c.cost else w.used end, c.doc, w.used + c.cost <= 4000
      from w join c on c.qid = w.qid and c.i = w.i + 1)
select qid, row_number() over (partition by qid order by i) - 1 as pos, doc, max(used) over (partition by qid) as used from w where took""")
def budget_fill(spark, sf):
    """BM25 blocks packed into 4000 tokens per question, skipping what does not fit."""
    d = docs(spark, sf)
    cost = d.select("doc", "text", (T.tokens(P.rendered("rel", "date", T.strip("text"))) + 1).alias("cost"))
    r = R.bm25_within(cost, questions(spark, sf), 4000)
    order = [F.col("score").desc(), F.col("doc").desc()]
    cand = Bd.bounded_candidates(r, "qid", order, "cost", 4000, 5)
    from pyspark.sql import Window
    cand = cand.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    f = Bd.fill(cand, "qid", "rank", "cost", "doc", 4000, 5)
    return f.select("qid", F.col("pos").cast("long").alias("pos"), "doc", F.col("used").cast("long").alias("used"))


@query(f"""
with l as (select doc_id, i, line, cast((length(line) + 3) // 4 as bigint) as c from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
u as (select *, coalesce(sum(c + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) + c > 350 as over_ from l)
select doc_id, cast(count(*) as bigint) as n_lines, cast(sum(c) as bigint) as n_tokens from (
  select *, max(over_) over (partition by doc_id order by i) as bad from u) where not bad group by doc_id""")
def line_prefix_cut(spark, sf):
    """Lines of each document until the first that would pass 350 tokens."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.withColumn("r", F.col("i") + 1).withColumn("c", T.tokens("line"))
    kept = Bd.prefix_cut(lines, ["doc_id"], "r", F.col("c"), F.lit(350), F.lit(0))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("c").alias("n_tokens"))


def eval_questions(spark, sf) -> DataFrame:
    """questions(qid, question, category, gold): gold are the documents that hold the text; a question
    without any is an abstention."""
    q = questions(spark, sf)
    g = passages(docs(spark, sf), q).groupBy("qid").agg(F.collect_set(F.col("doc").cast("string")).alias("gold"))
    q = q.join(g, "qid", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))
    return q.withColumn("category", F.when(F.size("gold") > 0, F.lit("single")).otherwise(F.lit("abstention")))


def refs(r: DataFrame) -> DataFrame:
    return r.select("qid", F.col("doc").cast("string").alias("ref"), "rank")


@query(Q.GOLD)
def passage_gold(spark, sf):
    return passages(docs(spark, sf), questions(spark, sf))


_HITS = """q as (select item_id as qid, case when item_id in (select qid from g) then 'single' else 'abstention' end as category from benchmark),
h as (select q.qid, q.category, min(r.rank) as rank from q left join (select r.* from r join g using (qid, doc)) r on r.qid = q.qid group by all)"""


@query(f"""with {Q.bm25('r', 5)}, g as ({Q.GOLD}), {_HITS}
select coalesce(category, 'all') as category, cast(count(*) as bigint) as n, cast(count(*) filter (where category2 = 'single') as bigint) as scored,
  cast(count(rank) as bigint) as hits, round(sum(coalesce(1.0 / rank, 0)) / nullif(count(*) filter (where category2 = 'single'), 0), 6) as mrr
from (select *, category as category2 from h) group by rollup (category)""")
def hit_mrr_rollup(spark, sf):
    q = eval_questions(spark, sf)
    return E.summary(E.hit_rows(q, refs(R.bm25(docs(spark, sf), q, 5)), 5))


@query(f"""with {Q.bm25('r', 5)}, {Q.grep('s', 5)}, g as ({Q.GOLD}),
p as (select item_id as qid, cast(exists (select 1 from r join g using (qid, doc) where r.qid = item_id) as int) as a,
             cast(exists (select 1 from s join g using (qid, doc) where s.qid = item_id) as int) as b from benchmark),
o as (select row_number() over (order by sha1(cast(qid as varchar)), qid) - 1 as place, a - b as d, count(*) over () as n from p),
x as (select r.b, cast(('0x' || left(sha1(r.b || ':' || i.i), 8)) as bigint) % (select max(n) from o) as place
      from range(10000) r(b) cross join (select unnest(range((select max(n) from o))) as i) i),
t as (select x.b, sum(o.d) as d from x join o using (place) group by x.b)
select cast(count(*) filter (where d <= 0) as bigint) as worse, cast(count(*) as bigint) as resamples, (select cast(max(n) as bigint) from o) as n,
  round(count(*) filter (where d <= 0) / count(*), 6) as p from t""")
def paired_bootstrap(spark, sf):
    """BM25 against keyword count, hit at 5, over 10 000 resampled question sets."""
    d, q = docs(spark, sf), eval_questions(spark, sf)
    hit = lambda r, name: E.hit_rows(q, refs(r), 5).select("qid", F.coalesce("hit", F.lit(False)).cast("int").alias(name))
    a, b = hit(R.bm25(d, q, 5), "a"), hit(R.grep(d, q, 5), "b")
    return E.paired_bootstrap(a.join(b, "qid").withColumnRenamed("qid", "id"))


@query(f"""with {Q.bm25('r', 5)}, {Q.grep('s', 5)}, g as ({Q.GOLD}),
k as (select cast(count(distinct qid) as double) as n from g),
b as (select count(*) as hits, sum(1.0 / rank) / (select n from k) as mrr from (select qid, min(rank) as rank from r join g using (qid, doc) group by qid)),
a as (select count(*) as hits, sum(1.0 / rank) / (select n from k) as mrr from (select qid, min(rank) as rank from s join g using (qid, doc) group by qid))
select cast(b.hits as bigint) as before_hits, cast(a.hits as bigint) as after_hits,
  case when a.hits < b.hits or coalesce(a.mrr, 0) < coalesce(b.mrr, 0) then 'rejected: score' else 'applied' end as decision from a, b""")
def eval_gate(spark, sf):
    """The gate's decision if keyword count replaced BM25."""
    from ..operators import lint as L

    d, q = docs(spark, sf), eval_questions(spark, sf)
    s = lambda r: E.summary(E.hit_rows(q, refs(r), 5))
    lost = d.select("doc").where("false")
    g = L.gate(s(R.bm25(d, q, 5)), s(R.grep(d, q, 5)), lost)
    return g.select(F.col("b_hits").alias("before_hits"), F.col("a_hits").alias("after_hits"), "decision")
