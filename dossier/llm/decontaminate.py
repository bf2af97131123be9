"""Benchmark decontamination in DataFrame operations only.

Item-sized windows of the documents and the benchmark items are compared by 64-bit SimHashes of their words, and then by weighted
similarity of whole five-word shingle sets, in which a shingle counts the more, the fewer benchmark items have it. Every window of
every document counts; nothing is sampled.

Windows that cannot match get no fingerprint: a window's similarity with an item is at most the share of the item's weight that it
has, and that is at most the share that its document has. The fingerprints of the others meet their item's in an index of twenty
blocks, one of which agrees for any two within nineteen bits. Windows that have as many of the item's shingles as two equally large
sets of the wanted similarity share lie well within (three and a half standard deviations). Where fewer shingles make up the
similarity by their weight, words may differ more than any radius covers: these windows are verified as they are. A window without a
whole shingle of the item has similarity 0. The shingles of the benchmark are broadcast if counted to be few, else joined by shuffle.

Items and documents with fewer than five words are one shingle. Null or empty texts match nothing; null ids match nothing.
Repeated rows and rows that share an id count as one document; items that share an id are items of their own, and the best of them
counts for the id. An empty table on either side matches nothing. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, small, stored
from .simhash import wide_fingerprint, wide_sums, words

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = [(4 * i, 4) for i in range(4)] + [(16 + 3 * i, 3) for i in range(16)]     # (first bit, bits)
RADIUS = len(BLOCKS) - 1        # bits in which fingerprints may differ: fewer than blocks, so one block agrees


def _shingles(df: DataFrame, keep: list[str], k: int) -> DataFrame:
    """keep, at, sh: the k-word shingles of the word array `w`, by place."""
    run = F.arrays_zip(*[F.slice("w", 1 + j, F.greatest(F.size("w") - (k - 1), F.lit(0))).alias(f"w{j}") for j in range(k)])
    e = df.where(F.size("w") >= k).select(*keep, F.posexplode(run).alias("at", "x"))
    return e.select(*keep, "at", F.xxhash64(F.lit(k), *[F.col(f"x.w{j}") for j in range(k)]).alias("sh"))


def _set(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, sh: distinct shingles of `w`; a text of fewer words is one shingle."""
    parts = [_shingles(df, keep, SHINGLE)] + [_shingles(df.where(F.size("w") == k), keep, k) for k in range(1, SHINGLE)]
    return reduce(DataFrame.unionByName, parts).select(*keep, "sh").distinct()


def _fingerprints(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, fp: the SimHash of the word array `w`."""
    e = df.select(*keep, F.explode("w").alias("word")).select(*keep, F.xxhash64("word").alias("h"))
    return e.groupBy(*keep).agg(*wide_sums(F.col("h")), F.count(F.lit(1)).alias("_m")).select(*keep, wide_fingerprint("_m").alias("fp"))


def _block(c: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(c, first).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _keys(fp: str) -> Column:
    """One key per block: its number and its bits."""
    return F.array(*[F.lit(16 * i) + _block(F.col(fp), *b) for i, b in enumerate(BLOCKS)])


def _first_agreeing(x: str, y: str) -> Column:
    """The number of the first block in which two fingerprints agree; a pair counts in that one only."""
    differing = F.col(x).bitwiseXOR(F.col(y))
    return F.coalesce(*[F.when(_block(differing, *b) == 0, F.lit(i)) for i, b in enumerate(BLOCKS)])


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of windows(item, fp, ...) whose fingerprint is within the radius of their item's, by an index on blocks of items(item, fp)."""
    index = small(stored(items.select("item", F.col("fp").alias("item_fp"), F.explode(_keys("fp")).alias("key")), "index"))
    probe = windows.withColumn("key", F.explode(_keys("fp")))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS) & (F.shiftright("key", 4) == _first_agreeing("fp", "item_fp"))
    return probe.join(index, ["item", "key"]).where(near).drop("key", "item_fp")


def matches(docs: DataFrame, items: DataFrame, id_: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
            similarity: float = SIMILARITY) -> DataFrame:
    """id, item id, start (word), size, similarity: the best window of each document for each item that it holds (stored)."""
    with scratch(docs.sparkSession) as keep:
        return keep(_matches(docs, items, id_, text, item_id, item_text, similarity), "matches")


def _matches(docs: DataFrame, items: DataFrame, id_: str, text: str, item_id: str, item_text: str, similarity: float) -> DataFrame:
    named = F.struct(F.col(item_id).alias("id"), F.xxhash64(item_text).alias("version"))     # texts of one id are told apart
    it = stored(items.where(F.col(item_id).isNotNull()).select(named.alias("item"), words(item_text).alias("w"))
                .where(F.size("w") > 0).dropDuplicates(["item"]).withColumn("n", F.size("w")), "items")
    lengths = [r[0] for r in it.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect()]    # at most five values
    # texts of one id are told apart, so that no window is put together from two of them
    text_of = ["doc", "version"]
    d = docs.where(F.col(id_).isNotNull()).select(F.col(id_).alias("doc"), F.xxhash64(text).alias("version"), words(text).alias("w"))

    # weights from all items; a shingle of no item weighs like one of a single item
    item_sets = stored(_set(it, ["item"]), "item_sets")
    total = it.count()
    weight = F.log(1 + F.lit(float(total)) / F.greatest(F.col("df"), F.lit(1)))
    df_ = small(stored(item_sets.groupBy("sh").agg(F.count(F.lit(1)).alias("df")), "df"))
    weighed = small(stored(item_sets.join(df_, "sh").select("item", "sh", weight.alias("weight")), "weights"))
    item_sum = small(stored(weighed.groupBy("item").agg(F.sum("weight").alias("item_weight"), F.count(F.lit(1)).alias("shingles")), "item_weights"))

    # where the documents have shingles of items
    known = df_.select("sh")
    hits = [_shingles(d, text_of, k).join(known, "sh", "left_semi").select(*text_of, "at", "sh", F.lit(k).alias("k")) for k in lengths]
    none = d.select(*text_of, F.lit(0).alias("at"), F.lit(0).cast("long").alias("sh"), F.lit(0).alias("k")).where(F.lit(False))
    # repeated rows give repeated hits; what follows counts each shingle of a document or window once
    hits = stored(reduce(DataFrame.unionByName, hits, none), "hits")
    enough = similarity * F.col("item_weight") - 1e-6
    share = hits.select(*text_of, "sh").distinct().join(weighed, "sh").groupBy(*text_of, "item").agg(F.sum("weight").alias("share"))
    sized = item_sum.join(it.select("item", "n"), "item")
    pairs = stored(share.join(sized, "item").where(F.col("share") >= enough).select(*text_of, "item", "n", "item_weight", "shingles"), "pairs")

    # every window of the item's size that holds a shared shingle whole, with the weight of all that it holds
    window = [*text_of, "start", "n"]
    starts = F.sequence(F.greatest(F.col("at") - F.col("n") + F.col("k"), F.lit(0)), F.col("at"))
    common = hits.join(pairs, text_of).join(weighed, ["item", "sh"]).select(*text_of, "n", "item", "item_weight", "shingles", "sh", "weight", F.explode(starts).alias("start")) \
        .distinct().groupBy(*window, "item", "item_weight", "shingles").agg(F.sum("weight").alias("common"), F.count(F.lit(1)).alias("held"))
    common = stored(common.where(F.col("common") >= enough), "common")

    # the words of these windows, as far as the document goes
    laid = d.join(small(stored(common.select(*window).distinct(), "windows")), text_of).select(*window, F.slice("w", F.col("start") + 1, F.col("n")).alias("w"))
    laid = stored(laid.distinct(), "laid")
    likely = common.where(F.col("held") * (1 + similarity) >= 2 * similarity * F.col("shingles"))
    by_weight = common.where(F.col("held") * (1 + similarity) < 2 * similarity * F.col("shingles"))
    marked = likely.join(_fingerprints(laid, window), window)
    near = within_radius(marked, stored(_fingerprints(it, ["item"]), "item_fingerprints")).select(*window, "item", "item_weight", "common")
    near = stored(near.unionByName(by_weight.select(near.columns)), "near")

    left = laid.join(small(stored(near.select(*window).distinct(), "left")), window, "left_semi")
    sets = _set(left, window).join(df_, "sh", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("weight", weight)
    window_sum = stored(sets.groupBy(*window).agg(F.sum("weight").alias("window_weight")), "window_weights")
    scored = near.join(window_sum, window) \
        .withColumn("similarity", F.round(F.col("common") / (F.col("window_weight") + F.col("item_weight") - F.col("common")), 9)) \
        .where(F.col("similarity") >= similarity)
    best = F.min_by(F.struct("start", "n", "similarity"), F.struct(-F.col("similarity"), "start"))
    return scored.groupBy("doc", F.col("item.id").alias("item")).agg(best.alias("b")).select(
        F.col("doc").alias(id_), F.col("item").alias(item_id), F.col("b.start").cast("long").alias("start"), F.col("b.n").cast("long").alias("size"), "b.similarity")


def clean(docs: DataFrame, items: DataFrame, id_: str = "doc_id", **names) -> DataFrame:
    """The documents that hold no benchmark item."""
    held = stored(matches(docs, items, id_, **names).select(id_).distinct(), "held")
    return docs.join(small(held), id_, "left_anti")
