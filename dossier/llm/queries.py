"""The corpus operators over the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, licenses, linededup, mixing, neardup, periodic, pii, quality, secrets, tokens, trie, urls
from .common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


@query()
def op1_secret_scan(spark, sf_dir):
    return secrets.scan(documents(spark, sf_dir), ["doc_id"])


@query()
def op2_pii_scan(spark, sf_dir):
    return pii.scan(documents(spark, sf_dir))


_LINKS = r"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 2 then [w[1]]
  else list_transform(range(1, len(w)), lambda i: w[i] || chr(10) || w[i + 1]) end)) as s from w),
r as (select s, min(doc_id) as rep, len(s) as n from s where len(s) > 0 group by s),
x as (select rep, n, unnest(s) as e from r),
f as (select e, count(*) as c from x group by e),
o as (select rep, n, x.e, row_number() over (partition by rep order by c, x.e) as k from x join f using (e)),
p as (select rep, n, e from o where k <= n - ceil(n * 80 / 100.0) + 1),
c as (select distinct a.rep as a, b.rep as b, a.n as an, b.n as bn from p a join p b on a.e = b.e and a.rep < b.rep
  and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n),
i as (select c.a, c.b, an, bn, count(*) as n from c join x on x.rep = c.a join x y on y.rep = c.b and y.e = x.e group by all),
l as (select a, b from i where 100 * n >= 80 * (an + bn - n)),
g as (select a, b from l union all select b, a from l),
t as (with recursive t(id, to_) as (select rep, rep from r union select t.id, g.b from t join g on g.a = t.to_) select * from t),
m as (select id, min(to_) as comp from t group by id)
select doc_id, len(s.s)::bigint as n_shingles, coalesce(m.comp, doc_id) as component_id, coalesce(m.comp, doc_id) = doc_id as kept
from s left join r on r.s = s.s and len(s.s) > 0 left join m on m.id = r.rep"""


@query(_LINKS)
def op3_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(documents(spark, sf_dir), words=2)


@query()
def op4_line_dedup(spark, sf_dir):
    return linededup.dedup_lines(documents(spark, sf_dir)).select("row.doc_id", "n_lines", "n_removed", F.col("kept_text").alias("text"))


@query()
def op5_quality_rules(spark, sf_dir):
    return quality.judge(documents(spark, sf_dir), ["doc_id"]).select(
        "doc_id", *quality.MEASURES, "base_failed", "kept", F.round("posterior", 9).alias("posterior"))


@query()
def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    counted = tokens.count(documents(spark, sf_dir), ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))
    return tokens.over(counted, 2048)


@query()
def op7_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir), ["doc_id"])


@query()
def op8_decontaminate(spark, sf_dir):
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query()
def op9_mix_sources(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("rate", 9).alias("rate"))


@query()
def op10_url_filter(spark, sf_dir):
    return urls.verdicts(table(spark, sf_dir, "pages"))


@query()
def op11_prefix_trie(spark, sf_dir):
    return trie.build(trie.rebuilt(trie.turns(table(spark, sf_dir, "conversations"))))


@query()
def op12_fingerprints(spark, sf_dir):
    return fingerprint.digests(documents(spark, sf_dir))


@query()
def op13_periodic_runs(spark, sf_dir):
    return periodic.digests(periodic.planted(documents(spark, sf_dir)), ["doc_id"])
