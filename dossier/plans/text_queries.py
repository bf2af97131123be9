"""Cleaning, keys, tokens, redaction and splitting over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import parse as P
from ..sources.tables import notes, table
from . import sqltext as Q
from .registry import query


@query(f"""
select doc_id, sha1(slug) as slug_sha, left(sha1(slug || chr(0) || rel || chr(0) || lang), 10) as k from (
  select doc_id, lang, source || '/' || doc_id || '.md' as rel,
         trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') as slug from documents)""")
def slugify_keys(spark, sf):
    n = notes(spark, sf).withColumn("slug", T.slugify("text"))
    return n.select("doc_id", F.sha1("slug").alias("slug_sha"), T.entry_key("slug", "rel", "lang").alias("k"))


@query(f"select doc_id, {Q.tokens('text')} as n_tokens, cast(len({Q.words('text')}) as bigint) as n_words from documents")
def token_lengths(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.tokens("text").alias("n_tokens"), F.size(T.words("text")).cast("long").alias("n_words"))


def _terms(spark, sf, fn):
    t = table(spark, sf, "documents").select("doc_id", fn("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.sha1(F.array_join("t", " ")).alias("terms_sha"))


def _terms_sql(expr):
    return f"select doc_id, cast(len(t) as bigint) as n, sha1(array_to_string(t, ' ')) as terms_sha from (select doc_id, {expr} as t from documents)"


@query(_terms_sql(Q.domain_terms("text")))
def terms_domain(spark, sf):
    return _terms(spark, sf, T.domain_terms)


@query(_terms_sql(Q.eval_terms("text")))
def terms_eval(spark, sf):
    return _terms(spark, sf, T.eval_terms)


@query(_terms_sql(Q.fact_words("text")))
def words4(spark, sf):
    return _terms(spark, sf, T.fact_words)


@query(_terms_sql(Q.numbers("text")))
def number_sets(spark, sf):
    return _terms(spark, sf, T.numbers)


def marked_up(text):
    """Short lines become headings, so the whole text splits into many sections."""
    return F.regexp_replace(text, "(?m)^([^\\n]{1,60})$", "## $1")


_MARKED = "regexp_replace(text, '(?m)^([^\\n]{1,60})$', '## \\1', 'g')"


@query(f"""
with l as (select doc_id, unnest(string_split({_MARKED}, chr(10))) as line,
                  generate_subscripts(string_split({_MARKED}, chr(10)), 1) as i from documents),
f as (select *, case when regexp_matches(line, '^#{{1,6}}\\s+.') then 1 else 0 end as h from l),
g as (select *, sum(h) over (partition by doc_id order by i) as b from f)
select doc_id, cast(b as bigint) - min(cast(b as bigint)) over (partition by doc_id) as block,
  max(case when h = 1 then regexp_extract(line, '^#{{1,6}}\\s+(.+?)\\s*#*$', 1) end) as heading, cast(count(*) as bigint) as n_lines,
  sha1(string_agg(line, chr(10) order by i)) as text_sha
from g where not (i = (select max(x.i) from g x where x.doc_id = g.doc_id) and line = '' and i > 1) group by doc_id, b""")
def line_blocks(spark, sf):
    n = notes(spark, sf).withColumn("body", marked_up(F.col("text")))
    b = n.select("doc_id", F.explode(P.blocks("body")).alias("b"))
    return b.select("doc_id", F.col("b.block").cast("long").alias("block"), F.col("b.heading").alias("heading"),
                    F.size(F.split("b.text", "\n")).cast("long").alias("n_lines"), F.sha1("b.text").alias("text_sha"))


@query(f"""
with l as (select doc_id, lang, {Q.DAY} as day, unnest(string_split({_MARKED}, chr(10))) as line,
                  generate_subscripts(string_split({_MARKED}, chr(10)), 1) as i from documents),
g as (select *, sum(case when regexp_matches(line, '^##\\s+.') then 1 else 0 end) over (partition by doc_id order by i) as b,
             min(case when regexp_matches(line, '^##\\s+.') then i end) over (partition by doc_id) as first_h from l),
c as (select doc_id, lang, day, b, max(case when b > 0 and regexp_matches(line, '^##\\s+.') then regexp_extract(line, '^##\\s+(.+)', 1) end) as heading,
        string_agg(line, chr(10) order by i) as body from g group by all),
z as (select doc_id, day, 0 as b, cast(null as varchar) as heading, '---' || chr(10) || 'lang: ' || lang || chr(10) || 'date: ' || day || chr(10) || '---' ||
        coalesce(chr(10) || max(case when b = 0 then body end), '') as body from c group by doc_id, day, lang
      union all select doc_id, day, b, heading, body from c where b > 0),
t as (select *, trim(regexp_replace(regexp_replace(body, '^\\s+', ''), '\\s+$', '')) as text from z)
select doc_id, cast(row_number() over (partition by doc_id order by b) - 1 as bigint) as no, heading, day as date, sha1(text) as text_sha,
  cast((length('[' || doc_id || '.md | ' || day || ']' || chr(10) || text) + 3) // 4 as bigint) as n_tokens from t where text <> ''""")
def note_chunks(spark, sf):
    n = notes(spark, sf)
    head = F.concat(F.lit("---\nlang: "), "lang", F.lit("\ndate: "), "date", F.lit("\n---\n"))
    n = n.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("rel"),
                 F.concat(head, marked_up(F.col("text"))).alias("text"), "mtime", "in_vault")
    c = P.chunks(n)
    return c.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), F.col("no").cast("long").alias("no"), "heading",
                    "date", F.sha1("text").alias("text_sha"), F.col("n_tokens").cast("long").alias("n_tokens"))


@query("""
select doc_id, cast(count(*) filter (where secret) as bigint) as dropped,
  sha1(coalesce(string_agg(line, chr(10) order by i) filter (where not secret), '')) as kept_sha
from (select *, regexp_matches(line, '[A-Za-z0-9_/+=-]{32,}') as secret from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))
group by doc_id""")
def secret_lines_dropped(spark, sf):
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~T.has_secret(x))
    return table(spark, sf, "documents").select("doc_id", (F.size(lines) - F.size(kept)).cast("long").alias("dropped"),
                                                F.sha1(F.array_join(kept, "\n")).alias("kept_sha"))


_KNOWN = r"regexp_replace(text, '\b(?:sk-|ghp_|gho_|github_pat_|xox[abpr]-|AKIA|AIza|eyJ)[A-Za-z0-9_.-]{16,}', '[redacted]', 'g')"
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


@query(f"""
with p as (select doc_id, text, regexp_extract_all({_KNOWN}, '[A-Za-z0-9_/+=.-]+|[^A-Za-z0-9_/+=.-]+') as ps from documents),
r as (select doc_id, text, list_transform(ps, lambda p: case when length(p) >= 32 and regexp_full_match(p, '[A-Za-z0-9_/+=.-]+')
  and len(list_filter(list_transform(string_split(p, '/'), lambda s: regexp_replace(s, '{_UUID}', '', 'g')), lambda s: length(s) >= 32 and (
    (regexp_matches(s, '[A-Z]') and regexp_matches(s, '[a-z]') and regexp_matches(s, '[0-9]')) or regexp_full_match(s, '[0-9a-fA-F]{{32,}}')))) > 0
  then '[redacted]' else p end) as out from p)
select doc_id, sha1(array_to_string(out, '')) as scrubbed_sha, array_to_string(out, '') <> text as changed from r""")
def scrub_tokens(spark, sf):
    d = table(spark, sf, "documents").withColumn("s", T.scrub("text"))
    return d.select("doc_id", F.sha1("s").alias("scrubbed_sha"), (F.col("s") != F.col("text")).alias("changed"))


@query(f"select doc_id, {Q.clean('text', 140)} as excerpt from documents")
def clean_excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean("text").alias("excerpt"))


@query("""
select doc_id, sha1(coalesce(string_agg(line, chr(10) order by i) filter (where not regexp_matches(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')), '')) as kept_sha
from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) group by doc_id""")
def email_lines_dropped(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1(T.scrub_email_lines("text")).alias("kept_sha"))


@query("""
select page_id, i - 1 as pos, regexp_replace(u, '[.,;\\\\]+$', '') as url from (
  select page_id, unnest(us) as u, cast(generate_subscripts(us, 1) as bigint) as i from (
    select page_id, regexp_extract_all(url || ' ' || html, 'https?://[^\\s)"''<>\\]]+') as us from pages))""")
def page_urls(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.posexplode(T.urls(F.concat_ws(" ", "url", "html"))).alias("pos", "url"))
    return p.select("page_id", F.col("pos").cast("long").alias("pos"), "url")


@query(f"select conv_id, turn, sha1({Q.norm_answer('text')}) as norm_sha from conversations")
def answer_normal(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha1(T.normal_answer("text")).alias("norm_sha"))


@query("""
select o_orderkey, concat_ws('|', strftime(d, '%Y-%m-%d'), strftime(d, '%B %-d'), strftime(d, '%b %-d'), strftime(d, '%-d %B'), strftime(d, '%-m/%-d')) as spellings,
  isoyear(d) || '-W' || lpad(cast(weekofyear(d) as varchar), 2, '0') as iso_week
from (select o_orderkey, cast(o_orderdate as date) as d from orders)""")
def date_keys(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", T.date_spellings(d).alias("spellings"), T.iso_week(d).alias("iso_week"))


@query(f"""
select doc_id, i - 1 as newest_first, case when i - 1 <= n - i then 2 * (i - 1) else 2 * (n - i) + 1 end as place from (
  select doc_id, row_number() over (partition by source order by {Q.DAY} desc, doc_id desc) as i, count(*) over (partition by source) as n from documents)""")
def ends_order(spark, sf):
    from ..operators import skew as S

    n = notes(spark, sf)
    p = S.ordinal(n, ["source"], "date", [F.col("doc_id").desc()], "i", newest_first=True)
    p = p.join(n.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source").withColumn("i", F.col("i").cast("long") - 1)
    return p.select("doc_id", F.col("i").alias("newest_first"), T.ends_position("i", "n").cast("long").alias("place"))
