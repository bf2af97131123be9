"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected groups.

Sketch (t coordinates): in round i every shingle is hashed with the round's function to a bin and a value, and the value i + v
competes for the bin's minimum; rounds t to 2t - 1 put everything into bin i - t, so every coordinate is filled whatever the set's
size, and the number of equal coordinates of two sketches is concentrated about t times their Jaccard similarity. Small sets
take several rounds, large ones usually one. Bands of equal coordinates make buckets; `link` compares within buckets without
pairing whole buckets, every comparison is on the full shingle sets, and documents with one shingle set are one item throughout.

With 32 bands of 4 coordinates a pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^32 < 5e-8. Members of a
bucket that are not in the group of its smallest are compared with the others only if their whole sketches (1024
coordinates, two bits each) agree as often as 0.8 implies, less four standard deviations, which a link misses with probability < 1e-4.

Null or empty text, or no words: an empty set, linked with nothing, kept. Rows that share a doc_id count as one document in
links; a null doc_id is linked with nothing and kept. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, lists, map_texts, mix, scratch, shingles, small, stored
from .link import link, ratio

BANDS, WIDTH = 32, 4
COORDINATES = 1024      # of a sketch; the bands use the first BANDS * WIDTH
MOST, COUNT = 1_000_000, 500      # bytes and texts sketched at once: a sketch takes 8 KB while it is made


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates (round in the high bits, value below) per non-empty set; rows of empty sets are all ones."""
    full = U(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * t, full)
    items = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items + U(0xA0761D6478BD642F * (i + 1) % (1 << 64)))
        value = (U(i) << U(48)) | (h >> U(16))
        place = owner * t + ((h % U(t)).astype(np.int64) if i < t else i - t)
        np.minimum.at(out, place, value)
        open_ = (out.reshape(-1, t) == full).any(1)
        stay = open_[owner]
        items, owner = items[stay], owner[stay]
    return out.reshape(-1, t)


def bands(rows: np.ndarray, bands_: int, width: int) -> np.ndarray:
    """64-bit keys of the bands of each sketch; the band's number is part of the key."""
    x = rows.reshape(len(rows), bands_, width)
    h = np.broadcast_to(np.arange(bands_, dtype=U) + U(1), x.shape[:2]).copy()
    for j in range(width):
        h = mix(h * U(0x9E3779B97F4A7C15) + x[:, :, j])
    return h


def packed(rows: np.ndarray) -> np.ndarray:
    """Two bits of every coordinate, thirty-two coordinates to a 64-bit word."""
    bits = (rows & U(3)).reshape(len(rows), -1, 32) << (U(2) * np.arange(32, dtype=U))
    return np.bitwise_or.reduce(bits, axis=2)


def alike(x: str, y: str, percent: int) -> Column:
    """Whether two packed sketches agree as often as sets of the wanted similarity do, less four standard deviations. Unequal
    coordinates agree in their two bits once in four."""
    agree = percent / 100 + (1 - percent / 100) / 4
    most = int((1 - agree + 4 * (agree * (1 - agree) / COORDINATES) ** 0.5) * COORDINATES)
    def differing(i):
        v = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        return F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return reduce(lambda a, b: a + b, [differing(i) for i in range(COORDINATES // 32)]) <= most


def first_common(x: str, y: str, bands_: int) -> Column:
    """The first of the bands in which two items agree; a pair counts in that one only."""
    return F.coalesce(*[F.when(F.col(x)[i] == F.col(y)[i], F.col(x)[i]) for i in range(bands_)])


def signatures(df: DataFrame, id_: str, text: str, words: int, bands_: int, width: int) -> DataFrame:
    """id, n_shingles, set_hi, set_lo (a 128-bit name of the shingle set), bands, sketch (packed)."""
    def make():
        def batch(texts: list) -> list[pa.Array]:
            sets = shingles(texts, words)
            rows = sketches(sets, COORDINATES)
            keys, short = bands(rows[:, :bands_ * width], bands_, width), packed(rows)
            name = [(np.add.reduce(mix(s), dtype=U), np.add.reduce(mix(s ^ U(0x5555555555555555)), dtype=U)) for s in sets]
            hi, lo = (np.array([x[k] for x in name], dtype=U).astype(np.int64) for k in (0, 1))
            filled = lambda x: lists([x[i] if len(s) else x[i][:0] for i, s in enumerate(sets)], pa.int64())
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array(hi), pa.array(lo), filled(keys), filled(short)]
        return batch

    return map_texts(df, [id_], text, make, "n_shingles bigint, set_hi bigint, set_lo bigint, bands array<bigint>, sketch array<bigint>", MOST, COUNT)


def sets_of(df: DataFrame, id_: str, text: str, words: int) -> DataFrame:
    """id and its whole shingle set."""
    def make():
        return lambda texts: [lists(shingles(texts, words), pa.int64())]

    return map_texts(df, [id_], text, make, "shingles array<bigint>")


def near_duplicates(df: DataFrame, id_: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
                    bands_: int = BANDS, width: int = WIDTH) -> DataFrame:
    """id, n_shingles, component_id, kept (stored): documents are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets; component_id is the smallest id reachable, and one document of each group is kept."""
    with scratch(df.sparkSession) as keep:
        return keep(_near_duplicates(df, id_, text, words, percent, bands_, width), "near")


def _near_duplicates(df: DataFrame, id_: str, text: str, words: int, percent: int, bands_: int, width: int) -> DataFrame:
    s = stored(signatures(df, id_, text, words, bands_, width), "signatures")
    filled = s.where((F.col("n_shingles") > 0) & F.col(id_).isNotNull())
    reps = stored(filled.groupBy("set_hi", "set_lo").agg(F.min(id_).alias("rep")), "sets")
    items = filled.join(reps, ["set_hi", "set_lo"]).where(F.col(id_) == F.col("rep"))
    items = stored(items.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "bands", "sketch"), "items")
    bucket = items.select(F.explode("bands").alias("key"), "id", "n")

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = stored(pairs.select(F.col("a").alias(id_)).union(pairs.select(F.col("b").alias(id_))).distinct(), "wanted")
        x = sets_of(df.join(small(wanted), id_, "left_semi"), id_, text, words)
        x = x.select(F.col(id_).alias("id"), "shingles")
        both = pairs.join(x.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a") \
            .join(x.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y")).cast("long")
        return both.withColumn("common", common) \
            .where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b").distinct()

    def plausible(x: str, y: str) -> Column:
        return alike(f"{x}.sketch", f"{y}.sketch", percent) & (first_common(f"{x}.bands", f"{y}.bands", bands_) == F.col("key"))

    comps, _ = link(bucket, verify, ratio(percent / 100), items.select("id", F.struct("sketch", "bands").alias("sketch")), plausible)
    comps = comps.select(F.col("id").alias("rep"), "comp")
    placed = stored(reps.join(comps, "rep", "left").select("set_hi", "set_lo", F.coalesce("comp", "rep").alias("component_id")), "placed")
    named = s.select(id_, "n_shingles", "set_hi", "set_lo", F.col("n_shingles").alias("_n"))
    linked = named.where((F.col("_n") > 0) & F.col(id_).isNotNull()).join(placed, ["set_hi", "set_lo"])
    alone = named.where((F.col("_n") == 0) | F.col(id_).isNull()).withColumn("component_id", F.col(id_))
    cols = [id_, "n_shingles", "component_id"]
    return linked.select(*cols).unionByName(alone.select(*cols)) \
        .withColumn("kept", F.coalesce(F.col(id_) == F.col("component_id"), F.lit(True)))


def survivors(df: DataFrame, id_: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of df without those that are in a group with a smaller id."""
    gone = stored(near_duplicates(df, id_, text, **names).where(~F.col("kept")).select(id_).distinct(), "gone")
    return df.join(small(gone), id_, "left_anti")
