"""Mixing sources to token targets by entropy balancing.

Targets: sources by code point (null last) weigh 5, 2, 1 repeating and share a multiple of all words; none gets more than twice
its own words, and what that leaves over is shared again by weight. Rates: of all rates in [0, 2] that meet a source's target,
those closest in relative entropy to taking every document once are 2 / (1 + exp(-lambda * size / mean)), one multiplier per
source. The multipliers maximise a concave dual; Newton's method finds them, each step one aggregation over (source, size,
count) rows, whose number is bounded by sources times distinct sizes. Rounding: documents are dealt by hash into groups of about
250, and within a group, largest first, each takes the 0, 1 or 2 copies that keep the words taken closest to the words
due so far, so a group ends within half its smallest document.

Null text: size 0, no words taken. A null source is a source of its own. Repeated rows are separate documents. Results depend on
the rows alone, so reruns agree. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
GROUP = 250
STEPS = 60


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """source, source_no, source_size, docs, target. One row per source."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    whole = Window.partitionBy(F.lit(0))
    by_name = whole.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (n - 1) % len(weights) + 1)
    s = s.select("*", n.alias("source_no"), weight.alias("w"), (share * F.sum("source_size").over(whole)).alias("all"))
    # in ascending order of limit per weight, sources are at their limit as long as an even share would exceed it
    s = s.withColumn("limit", MOST * F.col("source_size"))
    order = whole.orderBy(F.col("limit") / F.col("w"), "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("even", rest / left).withColumn("full", F.col("limit") <= F.col("even") * F.col("w"))
    level = F.max(F.when(~F.col("full"), F.struct(-F.col("limit") / F.col("w"), "even"))).over(whole)
    # rows with one limit per weight are all full or all open, so the first open one sets the level
    return s.select("source", "source_no", "source_size", "docs",
                    F.when(F.col("full"), F.col("limit")).otherwise(level["even"] * F.col("w")).alias("target"))


def rates(sized: DataFrame, goals: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """source_no, size, rate for every size that occurs in a source. `goals` is the stored result of `targets`."""
    grid = stored(sized.groupBy("source_no", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    ratio = F.col("target") / F.col("source_size")
    inside = ratio < MOST * (1 - 1e-9)
    state = goals.where(F.col("source_size") > 0).select(
        "source_no", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi"),
        F.when(inside, F.log(ratio / (MOST - ratio))).otherwise(F.lit(60.0)).alias("multiplier"), inside.alias("open"))
    state = stored(state, "multipliers")
    z = F.col("size") / F.col("mean")
    rate = MOST / (1 + F.exp(-F.col("multiplier") * z))
    for _ in range(STEPS):
        r = grid.where("size > 0").join(small(state.where("open")), "source_no").withColumn("r", rate)
        g = r.groupBy("source_no").agg(F.sum(F.col("n") * F.col("size") * F.col("r")).alias("got"),
                                       F.sum(F.col("n") * F.col("size") * z * F.col("r") * (1 - F.col("r") / MOST)).alias("slope"))
        miss = F.col("got") - F.col("target")
        lo = F.when(miss < 0, F.col("multiplier")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("multiplier")).otherwise(F.col("hi"))
        newton = F.col("multiplier") - miss / F.col("slope")
        safe = F.when((F.col("slope") > 0) & (newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        far = F.abs(miss) > tolerance * F.col("target")
        moved = state.join(small(stored(g, "newton")), "source_no", "left")
        state = stored(moved.select("source_no", "target", "mean", F.when(F.col("open"), lo).otherwise(F.col("lo")).alias("lo"),
                                    F.when(F.col("open"), hi).otherwise(F.col("hi")).alias("hi"),
                                    F.when(F.col("open") & far & (hi - lo > 1e-12), safe).otherwise(F.col("multiplier")).alias("multiplier"),
                                    (F.col("open") & far & (hi - lo > 1e-12)).alias("open")), "multipliers")
        if not state.where("open").limit(1).count():
            break
    else:
        raise RuntimeError("multipliers did not settle")
    full = F.col("multiplier") >= 60
    return grid.join(small(state), "source_no", "left") \
        .select("source_no", "size", F.coalesce(F.when(full, F.lit(MOST)).otherwise(rate), F.lit(0.0)).alias("rate"))


def _round(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies of one group's documents, largest first, carrying on what is due."""
    rows = rows.sort_values(["size", "h", "doc"], ascending=[False, True, True], kind="stable", ignore_index=True)
    due, copies = 0.0, []
    for size, rate in zip(rows["size"], rows["rate"], strict=True):
        due += rate * size
        c = min(MOST, max(0, round(due / size))) if size else round(rate)
        due -= c * size
        copies.append(int(c))
    rows["copies"] = copies
    return rows[["doc", "size", "h", "source_no", "rate", "copies"]]


def mix(df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
        share: float = SHARE) -> DataFrame:
    """id, source, h (hash of id and text), size, source_size, target, rate, copies, taken: one row per document."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(df.select(F.col(id_).alias("doc"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(id_, text).alias("h")), "sized")
    goals = stored(targets(sized, weights, share), "targets")
    named = goals.select(F.col("source").alias("_s"), "source_no", "docs")
    sized = sized.join(small(named), F.col("source").eqNullSafe(F.col("_s"))).select("doc", "size", "h", "source_no", "docs")
    rate = stored(rates(sized, goals), "rates")
    group = F.pmod(F.col("h"), F.ceil(F.col("docs") / GROUP))
    dealt = sized.withColumn("g", group).join(small(rate), ["source_no", "size"]).select("doc", "size", "h", "source_no", "rate", "g")
    kind = dict(dealt.dtypes)["doc"]
    done = dealt.groupBy("source_no", "g").applyInPandas(_round, f"doc {kind}, size bigint, h bigint, source_no int, rate double, copies int")
    out = done.join(small(goals), "source_no")
    return out.select(F.col("doc").alias(id_), F.col("source"), "h", "size", "source_size", "target", "rate", F.col("copies").cast("long").alias("copies"),
                      (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", **names) -> DataFrame:
    """row (all columns of df, as they were), size, copies, taken, for documents that the mix takes. Rows equal in id and text
    take the same number of copies."""
    taken = mix(df, id_, text, source, **names).groupBy(F.col(id_).alias("id"), "h").agg(F.first("size").alias("size"), F.max("copies").alias("copies"))
    taken = small(stored(taken.where("copies > 0"), "taken"))
    rows = df.select(F.struct("*").alias("row"), F.col(id_).alias("row_id"), F.xxhash64(id_, text).alias("row_h"))
    return rows.join(taken, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_h") == F.col("h"))) \
        .select("row", "size", "copies", (F.col("copies") * F.col("size")).alias("taken"))
