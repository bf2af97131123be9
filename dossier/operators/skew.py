"""Ordered work over groups of any size.

A plain window sends a whole group to one task, so one key with a third of the rows would stall the
job. These helpers cut each group into buckets along its order (a value-based bucket column that is
monotone in the order), do the window inside a bucket, and carry one small row per bucket across
bucket borders. A hot key is then spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*order)


def ordinal(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], out: str = "ordinal",
            newest_first: bool = False) -> DataFrame:
    """1-based row number per key. Buckets must sort like `order` (descending if `newest_first`)."""
    direction = F.col(bucket).desc() if newest_first else F.col(bucket).asc()
    before = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n")) \
        .select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return df.withColumn("_in", inside).join(offsets, [*keys, bucket]) \
        .withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before")


def next_value(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: str,
               out: str) -> DataFrame:
    """The value on the following row of the same key (NULL on the last row)."""
    firsts = df.groupBy(*keys, bucket).agg(F.min_by(value, _order_struct(order)).alias("_first"))
    ahead = Window.partitionBy(*keys).orderBy(bucket)
    firsts = firsts.select(*keys, bucket, F.lead("_first").over(ahead).alias("_ahead"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return df.withColumn("_next", F.lead(value).over(inside)).join(firsts, [*keys, bucket]) \
        .withColumn(out, F.coalesce("_next", "_ahead")).drop("_next", "_ahead")


def carry_last(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str,
               inclusive: bool = True) -> DataFrame:
    """The latest non-NULL value at or before each row (strictly before if not `inclusive`)."""
    lasts = df.where(F.col(value).isNotNull()).groupBy(*keys, bucket) \
        .agg(F.max_by(value, _order_struct(order)).alias("_last"))
    spine = df.select(*keys, bucket).distinct().join(lasts, [*keys, bucket], "left")
    behind = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    spine = spine.select(*keys, bucket, F.last("_last", ignorenulls=True).over(behind).alias("_behind"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn("_here", F.last(value, ignorenulls=True).over(inside)) \
        .join(spine, [*keys, bucket]).withColumn(out, F.coalesce("_here", "_behind")).drop("_here", "_behind")


def running_max(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: Column,
                out: str) -> DataFrame:
    """The greatest value on strictly earlier rows of the same key (NULL on the first row)."""
    df = df.withColumn("_v", value)
    tops = df.groupBy(*keys, bucket).agg(F.max("_v").alias("_top"))
    behind = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, bucket, F.max("_top").over(behind).alias("_behind"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_here", F.max("_v").over(inside)).join(tops, [*keys, bucket]) \
        .withColumn(out, F.greatest("_here", "_behind")).drop("_v", "_here", "_behind")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows per key. The literal bound lets Spark cut each map task's rows to k per key
    before the shuffle, so a hot key sends k rows per task, not all of them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def multiset_digest(df: DataFrame, keys: Sequence[str], text: Column, out: str = "digest") -> DataFrame:
    """An order-free digest of the rows of each key: SHA-256 over lane sums of the row digests. It
    combines on the map side, so a key of any size is never gathered."""
    h = F.sha2(text, 256)
    lanes = [F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    sums = [F.sum(x).cast("string") for x in lanes]
    return df.groupBy(*keys).agg(
        F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256).alias(out))
