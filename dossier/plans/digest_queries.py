"""Conversations as sessions: replies and steps, first occurrences, packing, bounding, archiving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import digest as D
from ..sources.tables import notes, table
from . import sqltext as Q
from .registry import query


def turns(spark, sf) -> DataFrame:
    """Conversations as turns; system messages are no part of the talk."""
    c = table(spark, sf, "conversations", True).where("role <> 'system'")
    return c.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("session"), F.col("turn").alias("n"), F.lit(0).alias("b"), "role",
                    T.unnoise("text").alias("text"), F.lit("").alias("ts")).where("text <> ''")


def records(spark, sf) -> DataFrame:
    r = D.first_of_each(D.said_records(D.reply_or_step(turns(spark, sf))))
    return r.withColumn("src", F.concat("session", F.lit("#L"), F.col("n").cast("string"))).drop("n")


_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
_TURNS = f"""c as (select 'conv/' || conv_id as session, conv_id, turn, role, {_STRIP('text')} as text from conversations where role <> 'system'),
s as (select *, lead(role) over (partition by conv_id order by turn) as nxt, lead(turn) over (partition by conv_id order by turn) as nturn from c where text <> ''),
k as (select *, case when role = 'user' then 'prompt' when nxt is null or nxt = 'user' then 'reply' else 'step' end as kind from s)"""


@query(f"with {_TURNS} select session, turn, kind from k")
def digest_reply_step(spark, sf):
    return D.reply_or_step(turns(spark, sf)).select("session", F.col("n").alias("turn"), "kind")


_SQUEEZE = "regexp_replace(text, '[ \\t]*\\n\\s*\\n+', chr(10), 'g')"
# one line per step: the piece number moves on when the next line would pass 2000 characters
_PACK = f"""{_TURNS},
l as (select session, turn, kind, unnest(string_split({_SQUEEZE}, chr(10))) as line, generate_subscripts(string_split({_SQUEEZE}, chr(10)), 1) as i from k where kind <> 'prompt'),
p as (select session, turn, kind, i, line, 0 as piece, cast(length(line) + 1 as bigint) as size from l where i = 1 union all
  select l.session, l.turn, l.kind, l.i, l.line, case when p.size + length(l.line) > 2000 then p.piece + 1 else p.piece end,
    case when p.size + length(l.line) > 2000 then length(l.line) + 1 else p.size + length(l.line) + 1 end
  from p join l on l.session = p.session and l.turn = p.turn and l.i = p.i + 1),
r as (select session, turn, kind, piece, string_agg(line, chr(10) order by i) as text from p group by all union all
  select session, turn, kind, 0, case when length({_SQUEEZE}) <= 2000 then {_SQUEEZE} else left({_SQUEEZE}, 2000) || ' [...]' end from k where kind = 'prompt')"""


@query(f"with recursive {_PACK} select session, turn, kind, cast(piece as bigint) as piece, cast(length(text) as bigint) as size, sha1(text) as text_sha from r")
def digest_pack(spark, sf):
    t = D.reply_or_step(turns(spark, sf))
    p = F.when(F.col("kind") == "prompt", F.array(T.clip("text"))).otherwise(T.pieces("text"))
    r = t.select("session", F.col("n").alias("turn"), "kind", F.posexplode(p).alias("piece", "text"))
    return r.select("session", "turn", "kind", F.col("piece").cast("long").alias("piece"), F.length("text").cast("long").alias("size"), F.sha1("text").alias("text_sha"))


def _sql_scrub(x: str) -> str:
    uuid = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    known = rf"regexp_replace({x}, '\b(?:sk-|ghp_|gho_|github_pat_|xox[abpr]-|AKIA|AIza|eyJ)[A-Za-z0-9_.-]{{16,}}', '[redacted]', 'g')"
    return f"""array_to_string(list_transform(regexp_extract_all({known}, '[A-Za-z0-9_/+=.-]+|[^A-Za-z0-9_/+=.-]+'), lambda p: case when length(p) >= 32
  and regexp_full_match(p, '[A-Za-z0-9_/+=.-]+') and len(list_filter(list_transform(string_split(p, '/'), lambda s: regexp_replace(s, '{uuid}', '', 'g')), lambda s: length(s) >= 32 and (
  (regexp_matches(s, '[A-Z]') and regexp_matches(s, '[a-z]') and regexp_matches(s, '[0-9]')) or regexp_full_match(s, '[0-9a-fA-F]{{32,}}')))) > 0
  then '[redacted]' else p end), '')"""


_RECORDS = f"""{_PACK},
q as (select r.session, r.turn, r.kind, r.piece, {_sql_scrub('r.text')} as text,
  case when r.kind = 'prompt' then r.turn else coalesce(k.nturn, 4000000000000000000) end as at_n, r.kind = 'prompt' as late
  from r join k on k.session = r.session and k.turn = r.turn),
u as (select * from (select *, row_number() over (partition by session, kind, text order by at_n, late, piece) as rn from q where text <> '') where rn = 1)"""


@query(f"with recursive {_RECORDS} select session, turn, kind, cast(piece as bigint) as piece, sha1(text) as text_sha from u")
def digest_dedup(spark, sf):
    """The first record of each kind and text in a session."""
    r = D.first_of_each(D.said_records(D.reply_or_step(turns(spark, sf))))
    return r.select("session", F.col("n").alias("turn"), "kind", F.col("ord.piece").cast("long").alias("piece"), F.sha1("text").alias("text_sha"))


_JSON = """'{"kind": ' || to_json(kind) || ', "src": ' || to_json(session || '#L' || turn) || ', "text": ' || to_json(text) || ', "ts": ""}'"""


@query(f"""with recursive {_RECORDS},
o as (select *, length({_JSON}) + 1 as size, row_number() over (partition by session order by list_position(['prompt', 'reply', 'step'], kind), at_n, late, piece) as i from u),
b as (select session, cast(0 as bigint) as i, cast(0 as bigint) as used, cast(null as varchar) as kind, cast(null as bigint) as turn, cast(null as bigint) as piece, false as kept from (select distinct session from o)
  union all select o.session, o.i, case when b.used + o.size <= 3000 then b.used + o.size else b.used end, o.kind, o.turn, cast(o.piece as bigint), b.used + o.size <= 3000
  from b join o on o.session = b.session and o.i = b.i + 1)
select session, turn, kind, piece, kept from b where i > 0""")
def digest_bound(spark, sf):
    """What stays in a digest of 3000 characters and what overflows."""
    r = D.bound(records(spark, sf), limit=3000)
    return r.select("session", F.regexp_extract("src", r"#L(\d+)$", 1).cast("long").alias("turn"), "kind", F.col("ord.piece").cast("long").alias("piece"), "kept")


@query(f"""with o as (select distinct doc_id, unnest(string_split(text, chr(10))) as line from documents),
n as (select distinct doc_id, unnest(string_split({_sql_scrub('text')}, chr(10))) as line from documents)
select distinct doc_id || '' as path from (select * from o except select * from n)""")
def archive_diff(spark, sf):
    """Documents whose scrubbed digest lacks a line the old one holds."""
    n = notes(spark, sf).select(F.col("doc_id").cast("string").alias("path"), "text")
    lines = lambda c: n.select("path", F.explode_outer(F.split(c, "\n")).alias("line"))
    return D.archive_needed(lines(F.col("text")), lines(T.scrub("text")))


@query()
def note_digest(spark, sf):
    """Section records of every document, with heading trails, dates and line ranges."""
    from .text_queries import marked_up

    n = notes(spark, sf)
    n = n.select("rel", F.concat(F.lit("docs:"), "rel").alias("ref"), marked_up(F.col("text")).alias("text"), F.to_timestamp("date").alias("mtime"))
    return D.note_records(n).select("ref", "sec", "piece", "kind", F.sha1("text").alias("text_sha"), "ts", "src", "heading")
