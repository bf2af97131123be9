"""Groups of similar items from shared buckets, without pairing a bucket's members with each other.

Every bucket links its members to its smallest one, the verified links make groups, and only members that are then in
another group than their bucket's smallest are compared with the rest of the bucket. So a bucket of m copies of one text
costs m - 1 comparisons, and yet every pair that shares a bucket is either in one group already or compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored


def ratio(least: float) -> Callable[[str, str], Column]:
    """Sizes within a ratio of each other."""
    return lambda x, y: (F.col(x) >= least * F.col(y)) & (F.col(y) >= least * F.col(x))


ROUNDS = 60


def groups(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id of the stored edges(a, b): comp is the smallest id reachable.

    Alternating stars: all neighbours of a node are hung on its smallest neighbour, first the larger ones, then the smaller
    ones, until every tree is a star. Takes a number of rounds about logarithmic in a chain's length; each round is stored, and
    gone once the next one is."""
    with scratch(edges.sparkSession) as keep:
        return keep(_stars(edges), "groups")


def _stars(edges: DataFrame) -> DataFrame:
    e = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc")
        e = stored(both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m"))
                   .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        least = stored(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc")
        below = e.join(least.where("n > 1").select("u", "m"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stored(below.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        roots = nxt.select(F.col("v").alias("u")).distinct()
        many = nxt.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        e = nxt
        if not many and not nxt.join(roots, "u", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError("groups did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def link(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], fits: Callable[[str, str], Column], sketches: DataFrame | None = None,
         plausible: Callable[[str, str], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """buckets(key, id, n): fits(n, n) says cheaply whether two items can be linked at all; it may use `key` too. `verify` keeps the
    pairs (a, b) that are links. If fits has a function `refine`, that takes pairs before, leaves out some that cannot be links by a dearer
    test, and may add columns for `verify`. sketches(id, sketch) and plausible(sketch, sketch) rule out nearly all further pairs of a bucket
    that are no links before they become rows. Returns stored (id, comp) of all linked items and the verified links (a, b)."""
    with scratch(buckets.sparkSession) as keep:
        comps, links = _linked(buckets, verify, fits, sketches, plausible)
        return keep(comps, "groups"), keep(links, "links")


def _linked(buckets, verify, fits, sketches, plausible) -> tuple[DataFrame, DataFrame]:
    crowd = stored(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "n")).alias("m")).where("c > 1")
                   .select("key", F.col("m.id").alias("center"), F.col("m.n").alias("center_n")), "crowd")
    members = stored(buckets.join(crowd, "key"), "members")
    star = stored(members.where((F.col("id") != F.col("center")) & fits("n", "center_n"))
                  .select(F.col("center").alias("a"), F.col("id").alias("b")).distinct(), "star")
    refine = getattr(fits, "refine", lambda candidates: candidates)
    links = stored(verify(refine(star)), "links")
    comps = groups(links)
    at = stored(members.select("key", "id", "n", "center").join(comps, "id", "left").select("key", "id", "n", "center", F.coalesce("comp", "id").alias("comp")), "placed")
    mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("id") == F.col("center"), F.col("comp"))).alias("main")) \
        .where(F.col("lo") != F.col("hi")).select("key", "main")
    strays = at.drop("center").join(stored(mixed, "mixed"), "key").select("key", "id", "n", "comp", "main")
    known = stored(strays.withColumn("sketch", F.lit(0)) if sketches is None else strays.join(sketches, "id"), "strays")
    left = known.where(F.col("comp") != F.col("main")).select("key", F.col("id").alias("i"), F.col("n").alias("i_n"), F.col("comp").alias("i_comp"),
                                                             F.col("sketch").alias("i_sketch"))
    # two strays meet once: the smaller one asks
    asks = (F.col("comp") != F.col("i_comp")) & ((F.col("comp") == F.col("main")) | (F.col("i") < F.col("id")))
    pairs = left.join(known, "key").where(asks & fits("n", "i_n") & (F.lit(True) if plausible is None else plausible("sketch", "i_sketch")))
    pairs = pairs.select(F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b")).distinct()
    pairs = stored(pairs.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    more = stored(verify(refine(pairs)), "links")
    if more.limit(1).count():
        links = links.unionByName(more)
        comps = groups(stored(links, "links"))
    return comps, links
