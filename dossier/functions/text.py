"""Column expressions over text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def unix_lines(text) -> Column:
    """One newline convention: every line break a text reader would split on becomes `\\n`."""
    breaks = r"\r\n|[\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
    return F.regexp_replace(_c(text), breaks, "\n")


def strip(text) -> Column:
    """Without the white space of `(?U)\\s` at both ends; only the ends are read."""
    return F.btrim(_c(text), F.lit(X.SPACES))


def slugify(name) -> Column:
    dashed = F.regexp_replace(F.lower(_c(name)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def entry_key(slug, source, block) -> Column:
    parts = F.concat_ws("\u0000", _c(slug), _c(source), F.coalesce(_c(block), F.lit("")))
    return F.substring(F.sha1(parts), 1, 10)


def context_key(text) -> Column:
    return F.substring(F.sha1(_c(text)), 1, 12)


def clean(text, limit: int = 140) -> Column:
    """Markdown noise removed, whitespace collapsed, cut to `limit` characters with an ellipsis. One pass finds the texts that
    have any noise; the others lose only the blanks at their ends."""
    def cleaned(t):
        noisy = t.rlike(X.NOISY) | F.contains(t, F.lit("[[")) | F.contains(t, F.lit("  "))
        for bullet in ("- ", "+ ", " - ", " + "):
            noisy = noisy | t.startswith(bullet)
        s = F.regexp_replace(t, r"\[\[([^\]|]+\|)?([^\]]+)\]\]", "$2")
        s = F.regexp_replace(s, r"(?U)[*`>#]+|^\s*[-+] ", "")
        s = F.replace(s, F.lit(" — "), F.lit(", "))
        s = F.translate(s, "—–", "--")
        s = strip(F.when(noisy, F.regexp_replace(s, r"(?U)\s+", " ")).otherwise(t))
        # one pattern instead of a condition, so the text is cleaned once
        return F.regexp_replace(s, rf"(?s)\A(?=.{{{limit + 1}}})(.{{{limit - 4}}}[^ ]?).*\z", "$1...")

    return F.transform(F.array(_c(text)), cleaned)[0]   # a fold over one item, so an expression is computed once


def tokens(text) -> Column:
    """Budget tokens: four characters each, rounded up."""
    return F.floor((F.length(_c(text)) + 3) / 4).cast("long")


def raw_words(text) -> Column:
    """Word tokens with repeats, in order, in their own case."""
    return F.regexp_extract_all(_c(text), F.lit(f"({X.WORD})"), 1)


def words(text) -> Column:
    """Lower-cased word tokens with repeats, in order."""
    return F.transform(raw_words(text), F.lower)


def _sorted_terms(found: Column, stop, shortest: int) -> Column:
    keep = F.filter(F.array_distinct(found), lambda w: (F.length(w) >= shortest) & ~w.isin(stop))
    return F.sort_array(keep)


def domain_terms(text) -> Column:
    """Question terms of the budgeted retrievers: word tokens of two or more characters."""
    return _sorted_terms(words(text), X.STOP_DOMAIN, 2)


def eval_terms(text) -> Column:
    """Question terms of the evaluation arm: three or more characters, dots and dashes kept."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(f"({X.EVAL_TERM})"), 1)
    return _sorted_terms(found, X.STOP_EVAL, 3)


def fact_words(text) -> Column:
    """Evidence words: runs of four or more letters or digits."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(f"({X.WORD4})"), 1)
    return _sorted_terms(found, X.STOP_FACTS, 4)


def numbers(text) -> Column:
    return F.sort_array(F.array_distinct(F.regexp_extract_all(_c(text), F.lit(f"({X.NUMBER})"), 1)))


def jaccard(a, b) -> Column:
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / union)


def has_secret(text) -> Column:
    return _c(text).rlike(X.SECRET)


def unprivate(text) -> Column:
    return F.regexp_replace(_c(text), X.PRIVATE, "")


def unnoise(text) -> Column:
    return strip(F.regexp_replace(unprivate(text), X.NOISE, ""))


def scrub(text) -> Column:
    """Redact known key prefixes, then any run of 32 or more key characters with a suspicious
    `/`-segment: after dropping UUIDs, 32 or more characters that mix cases and digits or are hex."""
    c = X.TOKEN_CLASS
    known = F.regexp_replace(_c(text), X.KNOWN_KEY, "[redacted]")
    pieces = F.split(known, f"(?<=[^{c}])(?=[{c}])|(?<=[{c}])(?=[^{c}])")

    def fine(segment):
        s = F.regexp_replace(segment, X.UUID, "")
        mixed = s.rlike("[A-Z]") & s.rlike("[a-z]") & s.rlike("[0-9]")
        return (F.length(s) < 32) | ~(mixed | s.rlike("^[0-9a-fA-F]{32,}$"))

    def piece(p):
        token = (F.length(p) >= 32) & p.rlike(f"^[{c}]+$")
        return F.when(token & ~F.forall(F.split(p, "/"), fine), F.lit("[redacted]")).otherwise(p)

    whole = F.array_join(F.transform(pieces, piece), "")
    return F.when(_c(text).rlike(f"[{c}]{{32,}}"), whole).otherwise(known)


def squeeze_blank(text) -> Column:
    return F.regexp_replace(strip(text), r"(?U)[ \t]*\n\s*\n+", "\n")


def clip(text, cap: int = X.CAP) -> Column:
    return F.regexp_replace(squeeze_blank(text), rf"(?s)\A(.{{{cap}}}).+\z", r"$1 [...]")


def pack_lines(lines: Column, cap: int = X.CAP) -> Column:
    """Group consecutive lines into pieces of at most `cap` characters; a line is never cut, so a
    longer line is a piece of its own. The size restarts with each piece, hence a fold."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"),
                     F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def step(acc, line):
        n = F.length(line)
        full = (F.size(acc.open) > 0) & (acc["size"] + n > cap)
        return F.struct(
            F.when(full, F.concat(acc.done, F.array(acc.open))).otherwise(acc.done).alias("done"),
            F.when(full, F.array(line)).otherwise(F.concat(acc.open, F.array(line))).alias("open"),
            (F.when(full, F.lit(0)).otherwise(acc["size"]) + n + 1).alias("size"))

    return F.aggregate(lines, start, step, lambda a: F.transform(
        F.concat(a.done, F.array(a.open)), lambda p: F.array_join(p, "\n")))


def pieces(text, cap: int = X.CAP) -> Column:
    return pack_lines(F.split(squeeze_blank(text), "\n"), cap)


def urls(text) -> Column:
    found = F.regexp_extract_all(_c(text), F.lit(f"({X.URL})"), 1)
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;\\]+$", ""))


def scrub_email_lines(text) -> Column:
    """Lines that hold an e-mail address are dropped."""
    return F.array_join(F.filter(F.split(_c(text), "\n"), lambda x: ~x.rlike(X.EMAIL)), "\n")


def normal_answer(text) -> Column:
    s = F.lower(F.replace(_c(text), F.lit("’"), F.lit("'")))
    return strip(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9/'\- ]", " "), r"\s+", " "))


def has_phrase(answer_norm: Column, phrase: Column) -> Column:
    """Whole-phrase membership: no letter or digit may touch either end of the phrase."""
    walled = F.regexp_replace(answer_norm, "([^a-z0-9])", " $1 ")
    needle = F.regexp_replace(phrase, "([^a-z0-9])", " $1 ")
    return F.contains(F.concat(F.lit(" "), walled, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" "))) \
        & (phrase != "")


def answer_has(answer, key) -> Column:
    """Any `|` alternative of the key: as a whole phrase, or all of its two or more content words."""
    a = normal_answer(answer)

    def alternative(alt):
        n = normal_answer(alt)
        content = F.filter(F.split(n, " "), lambda w: ~w.isin(X.GENERIC) & (F.length(w) > 1))
        return has_phrase(a, n) | ((F.size(content) > 1) & F.forall(content, lambda w: has_phrase(a, w)))

    return F.exists(F.split(_c(key), r"\|"), alternative)


def alternatives(key) -> Column:
    parts = F.transform(F.split(_c(key), r"\|"), lambda a: F.lower(strip(a)))
    return F.filter(parts, lambda a: a != "")


def person_key(name) -> Column:
    return F.concat(_c(name), F.lit("|"), F.element_at(F.split(_c(name), r"\s+"), -1))


def not_found(answer) -> Column:
    return _c(answer).rlike(X.NOT_FOUND)


def unknown(answer) -> Column:
    return _c(answer).rlike(X.UNKNOWN)


def date_spellings(day) -> Column:
    """Alternative spellings of a date as one key: ISO, `October 3`, `Oct 3`, `3 October`, `10/3`."""
    d = _c(day)
    return F.concat_ws("|", *[F.date_format(d, f) for f in ("yyyy-MM-dd", "MMMM d", "MMM d", "d MMMM", "M/d")])


def iso_week(day) -> Column:
    d = _c(day)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def core_name(event) -> Column:
    """An event name without its leading article and without `friend's`."""
    return F.replace(F.regexp_replace(_c(event), "^(the|a) ", ""), F.lit("friend's "), F.lit(""))


def local_minute(ts, zone: str) -> Column:
    """ISO UTC text as `yyyy-MM-dd HH:mm` in an explicit zone; NULL when it does not parse."""
    t = F.try_to_timestamp(F.substring(_c(ts), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.date_format(F.from_utc_timestamp(t, zone), "yyyy-MM-dd HH:mm")


def ends_position(i, n) -> Column:
    """Place of item i (0-based) when a list of n is read newest, oldest, second newest, ..."""
    i, n = _c(i), _c(n)
    mirror = n - 1 - i
    return F.when(i <= mirror, 2 * i).otherwise(2 * mirror + 1)


def basename(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def dirname(path) -> Column:
    return F.regexp_replace(_c(path), "/?[^/]*$", "")


def link(rel, in_vault) -> Column:
    r = _c(rel)
    stem = F.regexp_replace(r, r"\.md$", "")
    return F.when(_c(in_vault), F.concat(F.lit("[["), stem, F.lit("|"), basename(stem), F.lit("]]"))) \
        .otherwise(F.concat(F.lit("`"), r, F.lit("`")))


def json_text(value) -> Column:
    """A string as a JSON literal; the two Unicode line separators are escaped as well."""
    quoted = F.regexp_extract(F.to_json(F.struct(_c(value).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    for mark in ("\u2028", "\u2029"):
        quoted = F.replace(quoted, F.lit(mark), F.lit("\\u%04x" % ord(mark)))
    return quoted


def canonical_json(fields: dict) -> Column:
    """One JSON object with sorted keys, `, ` and `: ` separators; NULL fields are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}": '), json_text(v))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def ref_of(result_file) -> Column:
    """`scheme://corpus/path?index=x` as `corpus:path`."""
    tail = F.regexp_replace(F.regexp_replace(_c(result_file), r"^[^:]*://", ""), r"\?index=.*$", "")
    return F.regexp_replace(tail, "^([^/]*)/", "$1:")


def model_cost(text, usd_per_million) -> Column:
    """Input cost of a prompt: four characters per token."""
    return F.floor(F.length(_c(text)) / 4) / 1e6 * usd_per_million
