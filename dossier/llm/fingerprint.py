"""Bottom-k fingerprints of documents in DataFrame functions only.

A text's shingles are five words in a row, in lower case (with fewer words the whole sequence, without words none), hashed to 64
bits; the sketch is the k smallest distinct hashes in order. Sketches of parts merge into the sketch of their union (the k smallest
of both), and two sketches estimate resemblance, containment and the number of distinct shingles, exactly while they are not full.

Texts are compared with the following document by ascending id (after the last: the first). The order is made on keys alone: a
range-partitioned table of ids and hashes, in which every row finds the next one inside its partition and partitions hand on their
first row. Each text is then shuffled once, to its own key, and only the part that the document before needs is sent there.

Null text is empty. Null ids come first. Rows that share an id follow one another by a hash of their text; rows equal in id and text
are one row with a count until the end, each followed by the next copy and the last by the next text. Two texts without words
are alike (1), a text with words and one without are not (0). An empty table gives an empty table; a single document follows
itself. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import next_value
from .common import stored

SHINGLE, K = 5, 128
SPACES = r"[\x20\x09-\x0D]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(_c(text)), SPACES), "")


def shingles(w: Column | str) -> Column:
    """Hashes of the shingles of an array of words. Places after the last word are null and add nothing to a hash."""
    w = _c(w)
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
    return F.when(F.size(w) > 0, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column | str, k: int = K) -> Column:
    """The sketch of an array of hashes."""
    return F.slice(F.sort_array(F.array_distinct(_c(hashes))), 1, k)


def merge(a: Column | str, b: Column | str, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(_c(a), _c(b))), 1, k)


def resemblance(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated share of common shingles among all of both: of the k smallest of the union, those in both sketches."""
    u = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(_c(a), _c(b)), u))
    return F.when(F.size(u) == 0, 1.0).otherwise(both / F.size(u))


def distinct(a: Column | str, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from how small the k-th hash is."""
    a = _c(a)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((F.get(a, F.lit(k - 1)) + 2.0 ** 63) / 2.0 ** 64))


def containment(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; null for a without shingles."""
    j, n, m = resemblance(a, b, k), distinct(a, k), distinct(b, k)
    return F.when(F.size(_c(a)) > 0, F.least(F.lit(1.0), j * (n + m) / ((1 + j) * n)))


def printed(a: Column | str) -> Column:
    """Sixteen hexadecimal digits per hash."""
    return F.array_join(F.transform(_c(a), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def sketches(df: DataFrame, keep: list[str], text: str = "text", k: int = K) -> DataFrame:
    """keep, sketch of every row's text."""
    return df.select(*keep, words(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_w")).select(*keep, bottom(shingles("_w"), k).alias("sketch"))


def followers(keys: DataFrame, order: list[str], value: list[str]) -> DataFrame:
    """The stored narrow rows of keys, each with `next`: the struct of `value` of the row after it by `order`, of the first row for the last."""
    placed = stored(keys.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_value", F.struct(*value)), "order")
    first = placed.groupBy().agg(F.min_by("_value", F.struct(*order)).alias("_first"))       # one row
    ahead = next_value(placed, [], "_part", order, "_value", "_after")
    return ahead.join(F.broadcast(first)).withColumn("next", F.coalesce("_after", "_first")).drop("_part", "_value", "_after", "_first")


def compare(df: DataFrame, id_: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch: every document, and what it becomes if its last half is
    replaced by the beginning of the document after it."""
    key = ["k1", "k2"]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(id_).alias("id"), t.alias("text")).select(
        "id", "text", F.xxhash64(F.col("id").isNull(), "id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "id").alias("k2"))
    keys = rows.select("id", *key, F.length("text").alias("n")).groupBy(*key).agg(F.first("id").alias("id"), F.first("n").alias("n"))
    pairs = followers(keys, ["id", *key], key).select("id", F.col("k1").alias("own1"), F.col("k2").alias("own2"), F.floor(F.col("n") / 2).cast("int").alias("wanted"),
                                                      F.col("next.k1").alias("k1"), F.col("next.k2").alias("k2"))
    pairs = stored(pairs, "pairs")
    # both uses read the same columns, so the texts are shuffled once
    texts = rows.groupBy(*key).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).where("copies > 0")
    sent = texts.join(pairs, key).select("id", "own1", "own2", F.substring(F.col("text"), F.lit(1), F.col("wanted")).alias("piece"), words("text").alias("_w"))
    sent = sent.select("id", "own1", "own2", "piece", bottom(shingles("_w"), k).alias("next_sketch"))
    own = texts.join(sent, (F.col("k1") == F.col("own1")) & (F.col("k2") == F.col("own2"))).withColumn("n", F.length("text")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    own = own.select("id", "text", "copies", "n", "next_sketch", "half", F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("half")).alias("head"), "piece", words("text").alias("_w")) \
        .select("*", bottom(shingles("_w"), k).alias("sketch")).drop("_w")
    # a copy is followed by the next copy, the last copy by the next text
    last = F.struct(F.col("piece").alias("tail"), F.col("next_sketch").alias("after"), F.lit(1).cast("long").alias("times"))
    before = F.struct(F.substring(F.col("text"), F.lit(1), F.col("half")).alias("tail"), F.col("sketch").alias("after"), (F.col("copies") - 1).alias("times"))
    kinds = own.select("id", "n", "sketch", "head", F.explode(F.when(F.col("copies") > 1, F.array(last, before)).otherwise(F.array(last))).alias("x"))
    edited = kinds.select("id", "n", "sketch", F.concat("head", "x.tail").alias("edited"), F.col("x.after").alias("next_sketch"), F.col("x.times").alias("times"))
    edited = edited.select("*", words("edited").alias("_w")).select("id", "n", "sketch", "next_sketch", "times", F.sha2("edited", 256).alias("edited_sha256"), bottom(shingles("_w"), k).alias("edited_sketch"))
    return edited.select(F.col("id").alias(id_), F.col("n").cast("long").alias("n_chars"), "edited_sha256", "sketch", "edited_sketch", "next_sketch",
                         F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_again")).drop("_again")


def digests(df: DataFrame, id_: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """compare() with fingerprints as text and the likeness of each document to its edited text and to the next document."""
    return compare(df, id_, text, k).select(
        id_, "n_chars", "edited_sha256", printed("sketch").alias("fingerprint"), printed("edited_sketch").alias("edited_fingerprint"),
        F.round(resemblance("sketch", "edited_sketch", k), 9).alias("near_edited"), F.round(resemblance("sketch", "next_sketch", k), 9).alias("near_next"),
        F.round(containment("sketch", "edited_sketch", k), 9).alias("contained_edited"), F.round(distinct("sketch", k), 3).alias("n_shingles"))
