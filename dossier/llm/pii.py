"""Personal data in DataFrame operations only: patterns for what is known, bootstrapped contexts for what is not.

Matches of the base expressions are seeds. The words before a seed are a lexical pattern; every other identifier-like word after
the same words is an instance of the pattern. Over the graph of patterns and instances, a pattern's confidence for a kind is the
share of its distinct instances believed to be of that kind (with pseudo-counts), an instance's belief is that of its best
confident pattern, and rounds of the two, until nothing changes, discover identifiers that no expression describes. A found identifier adds a span of
its kind; spans of the base stay. Random text gives no confident pattern: it needs several distinct instances, nearly all of one kind.

Positions: splitting a text by an expression and extracting what it matches give the gaps and the matches in turn, so their
lengths in code points add up to offsets. Expressions scan each run of characters once, so long texts take linear time.

Null or empty text: no spans. Null ids and repeated rows each give a row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The base expressions of the contract, in its order. They match the same spans: possessive repeats where what
# follows cannot begin inside the repeat, and a start only where a run begins or the last match ended.
LOCAL = "A-Za-z0-9._%+-"
EXPRESSIONS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(EXPRESSIONS)
# A text without this cannot have the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# Words with a digit or @ that may be identifiers.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
LEAST_CHARS = 6         # of a discovered identifier
SUPPORT = 5             # distinct instances of a confident pattern, at least
CONFIDENCE = 0.8
MOST_ROUNDS = 60        # patterns and beliefs settle far earlier; more is an error

_SPAN = "array<struct<start:int,end:int,found:string,before:string>>"


_WORD = r"\p{L}\p{M}\p{N}"


def _last_words(gap: Column) -> Column:
    """The last two words of a text, with what stands around them, however far from its end. Read from the end, so that only this part is looked at."""
    tail = F.reverse(F.regexp_extract(F.reverse(gap), rf"^[^{_WORD}]*+[{_WORD}]*+[^{_WORD}]*+[{_WORD}]*+", 0))
    return F.regexp_replace(tail, rf"[^{_WORD}]++", " ")


def _spans(text: str, expression: str) -> Column:
    """start, end (code points), the match and the two words before it, for every match."""
    found = F.regexp_extract_all(text, F.lit(expression), 0)
    gaps = F.split(text, expression, -1)
    each = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("found"), _last_words(x["g"]).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(each, zero, step)["out"]).otherwise(F.array().cast(_SPAN))


def _luhn(digits: Column) -> Column:
    """Whether the digits, every second one from the right doubled, sum to a multiple of ten."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int"))
                    .otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _passing(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _passes(kind, s["found"]))


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                s["found"].alias("found"), s["before"].alias("before")))


def base_spans(df: DataFrame, id_: str, text: str) -> DataFrame:
    """row, id, and per kind an array of passing spans; `words` holds the identifier-like words, whatever they are."""
    t = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    digit = F.col("t").rlike("[0-9]")
    cols = {}
    for kind, expression in EXPRESSIONS.items():
        can = F.contains("t", F.lit(NEEDS[kind])) & (digit if kind != "email" else F.lit(True)) if NEEDS[kind] else digit
        cols[kind] = F.when(can, _passing(kind, _spans("t", expression)))
    cols["words"] = F.when(digit | F.contains("t", F.lit("@")), _spans("t", CANDIDATE))
    empty = F.array().cast(_SPAN)
    return t.select("row", "id", *[F.coalesce(c, empty).alias(k) for k, c in cols.items()])


def _patterns(before: Column) -> Column:
    """The last word, and the last two, before an identifier."""
    w = F.array_remove(F.split(F.lower(before), " "), "")
    return F.when(F.size(w) > 0, F.array_distinct(F.array(F.element_at(w, -1), F.array_join(w, " ")))).otherwise(F.array().cast("array<string>"))


def discovered(spans: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """row, kind, start, end of identifiers found by context, when neither patterns nor their confidence (to 6 digits) change any more. `spans` is the stored result of `base_spans`."""
    known = spans.select("row", F.explode(F.flatten(F.array(*[_tagged(k) for k in KINDS]))).alias("s"))
    covered = F.flatten(F.array(*KINDS))
    open_ = F.filter("words", lambda w: ~F.exists(covered, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    free = spans.select("row", F.explode(open_).alias("s")).where(F.length(F.regexp_replace("s.found", r"[^\p{L}\p{N}@]", "")) >= LEAST_CHARS) \
        .select("row", F.struct(F.lit(None).cast("string").alias("kind"), "s.start", "s.end", "s.found", "s.before").alias("s"))
    spots = stored(known.unionByName(free).select("row", "s.kind", "s.start", "s.end", F.lower("s.found").alias("found"),
                                                  F.explode(_patterns(F.col("s.before"))).alias("pattern")), "spots")
    # one edge per pattern and instance; a seed's kind is certain
    edges = stored(spots.groupBy("pattern", "found").agg(F.min("kind").alias("seed")), "edges")
    belief = good = seen = None
    for _ in range(rounds):
        e = edges.withColumn("kind", F.col("seed")).withColumn("p", F.lit(1.0)).where("seed is not null")
        if belief is not None:
            more = edges.where("seed is null").join(belief, "found").select("pattern", "found", "seed", "kind", "p")
            e = e.unionByName(more)
        size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
        mass = e.groupBy("pattern", "kind").agg(F.sum(F.col("p").cast("decimal(30,9)")).cast("double").alias("mass"))
        confident = mass.join(size, "pattern").withColumn("confidence", F.col("mass") / (F.col("n") + 0.5)) \
            .where((F.col("confidence") >= CONFIDENCE) & (F.col("mass") >= SUPPORT - 1))
        good = stored(confident.select("pattern", "kind", "confidence"), "patterns")
        now = tuple(good.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("pattern", "kind", F.round("confidence", 6)))).first())
        if now == seen:
            break
        seen = now
        scored = edges.where("seed is null").join(good, "pattern").groupBy("found").agg(F.max(F.struct("confidence", "kind")).alias("b"))
        belief = stored(scored.select("found", F.col("b.kind").alias("kind"), F.col("b.confidence").alias("p")), "belief")
    else:
        raise RuntimeError("patterns did not settle")
    return spots.where("kind is null").drop("kind").join(good, "pattern") \
        .groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("row", "start", "end", F.col("b.kind").alias("kind"))


def scan(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_<kind> and base_sha256 of the base matches, spans (kind:start:end by kind, then start) with the discovered ones."""
    s = stored(base_spans(df, id_, text), "pii")
    new = stored(discovered(s).groupBy("row").agg(F.collect_list(F.struct(F.col("kind"), "start", "end")).alias("new")), "discovered")
    out = s.join(new, "row", "left")

    def line(kind: str, of: Column) -> Column:
        return F.transform(of, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    def every(kind: str) -> Column:
        place = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
        found = F.filter(F.coalesce("new", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda x: x["kind"] == kind)
        return F.array_sort(F.concat(F.transform(kind, place), F.transform(found, place)))

    joined = lambda of: F.array_join(F.flatten(F.array(*[line(k, of(k)) for k in KINDS])), ",")
    base, with_new = joined(F.col), joined(every)
    return out.select(F.col("id").alias(id_), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), with_new.alias("spans"))
