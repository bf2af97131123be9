"""Pieces of the SQL statements. Written from the definitions, not from the Spark expressions."""

from __future__ import annotations

from ..functions import fixed as X

DAY = "strftime(date '2024-01-01' + cast(doc_id % 30 as integer), '%Y-%m-%d')"


def lst(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9][A-Za-z0-9''-]*'), lambda w: lower(w))"


def domain_terms(x: str) -> str:
    return (f"list_sort(list_distinct(list_filter({words(x)}, lambda w: length(w) > 1 and "
            f"not list_contains({lst(X.STOP_DOMAIN)}, w))))")


def eval_terms(x: str) -> str:
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_.-]*[a-z0-9]'), "
            f"lambda w: length(w) > 2 and not list_contains({lst(X.STOP_EVAL)}, w))))")


def fact_words(x: str) -> str:
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]{{4,}}'), "
            f"lambda w: not list_contains({lst(X.STOP_FACTS)}, w))))")


def numbers(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({x}, '\\d[\\d.,:/-]*\\d|\\d')))"


def clean(x: str, n: int) -> str:
    s = f"regexp_replace({x}, '\\[\\[([^\\]|]+\\|)?([^\\]]+)\\]\\]', '\\2', 'g')"
    s = f"regexp_replace({s}, '[*`>#]+|^\\s*[-+] ', '', 'g')"
    s = f"replace(replace(replace({s}, ' — ', ', '), '—', '-'), '–', '-')"
    s = f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"
    return f"(case when length({s}) <= {n} then {s} else rtrim(left({s}, {n - 3})) || '...' end)"


def norm_answer(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(replace({x}, '’', '''')), '[^a-z0-9/''\\- ]', ' ', 'g'), "
            f"'\\s+', ' ', 'g'))")


def tokens(x: str) -> str:
    return f"cast((length({x}) + 3) // 4 as bigint)"


NOTES = f"select *, source || '/' || doc_id || '.md' as rel, {DAY} as day from documents"
RENDERED = "'[' || rel || ' | ' || day || ']' || chr(10) || trim(text, chr(10) || ' ')"
GOLD = "select b.item_id as qid, d.doc_id as doc from benchmark b join documents d on contains(d.text, b.text)"


def bm25(name: str, k: int | None, terms=domain_terms, words_=words) -> str:
    """CTEs ending in `name`(qid, doc, score, rank)."""
    cut = f"where rank <= {k}" if k else ""
    return f"""
    {name}_q as (select item_id as qid, unnest({terms('text')}) as term from benchmark),
    {name}_w as (select doc_id as doc, {words_('text')} as w from documents),
    {name}_n as (select count(*) as n, avg(len(w)) as avgdl from {name}_w),
    {name}_t as (select doc, term, count(*) as tf from (select doc, unnest(w) as term from {name}_w)
                 where term in (select term from {name}_q) group by all),
    {name}_d as (select term, count(*) as df from {name}_t group by term),
    {name}_s as (select q.qid, t.doc, round(sum(ln(1 + (n.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 /
                   (t.tf + 1.2 * (0.25 + 0.75 * len(w.w) / n.avgdl))), 6) as score
                 from {name}_q q join {name}_t t using (term) join {name}_d d using (term)
                 join {name}_w w on w.doc = t.doc cross join {name}_n n group by q.qid, t.doc),
    {name} as (select * from (select *, row_number() over (partition by qid order by score desc, doc desc) as rank
               from {name}_s where score > 0) {cut})"""


def grep(name: str, k: int) -> str:
    return f"""
    {name}_q as (select item_id as qid, unnest({domain_terms('text')}) as term from benchmark),
    {name}_s as (select q.qid, d.doc_id as doc, {DAY} as day, cast(count(*) as double) as score
                 from {name}_q q join documents d on contains(lower(d.text), q.term) group by all),
    {name} as (select * from (select *, row_number() over (partition by qid order by score desc, day desc, doc) as rank
               from {name}_s) where rank <= {k})"""


def tfidf(name: str, k: int) -> str:
    return f"""
    {name}_q as (select item_id as qid, unnest({eval_terms('text')}) as term from benchmark),
    {name}_v as (select distinct term from {name}_q),
    {name}_l as (select source as corpus, doc_id as doc, lower(unnest(string_split(text, chr(10)))) as line from documents),
    {name}_t as (select corpus, doc, term, count(*) as c from {name}_l join {name}_v on contains(line, term) group by all),
    {name}_d as (select corpus, term, count(*) as df from {name}_t group by all),
    {name}_n as (select source as corpus, count(*) as n from documents group by all),
    {name}_s as (select qid, doc, round(sum(ln(1 + n / df) * (1 + ln(c))), 6) as score
                 from {name}_q join {name}_t using (term) join {name}_d using (corpus, term) join {name}_n using (corpus) group by all),
    {name} as (select * from (select *, row_number() over (partition by qid order by score desc, doc) as rank
               from {name}_s) where rank <= {k})"""
