"""Values that change: as-of lookups, current and superseded values, set members, first and last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import skew as S


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str,
          bucket: Column, out: str = "value", inclusive: bool = True) -> DataFrame:
    """left plus the latest right value at or before its time. Both sides are stacked and the value is
    carried forward; `bucket` (of the common column `at`) cuts a hot key into time slices."""
    cols = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_time).alias("at"), F.lit(1 if inclusive else 0).alias("side"),
                    F.lit(None).cast(right.schema[value].dataType).alias("v"), F.struct(*cols).alias("row"))
    b = right.select(*keys, F.col(right_time).alias("at"), F.lit(0 if inclusive else 1).alias("side"), F.col(value).alias("v"),
                     F.lit(None).cast(a.schema["row"].dataType).alias("row"))
    both = a.unionByName(b).withColumn("slice", bucket)
    got = S.carry_last(both, keys, "slice", ["at", "side"], "v", out)
    return got.where(F.col("row").isNotNull()).select(*keys, "row.*", out)


def value_at(probes: DataFrame, changes: DataFrame, keys: list[str], day: str, bucket: Column) -> DataFrame:
    """changes(keys, old, new, day): the value a field had on a day. Before its first change a field had
    that change's old value."""
    first = changes.groupBy(*keys).agg(F.min_by("old", "day").alias("initial"))
    got = as_of(probes, changes.withColumnRenamed("day", "changed"), keys, day, "changed", "new", bucket)
    return got.join(first, keys, "left").withColumn("value", F.coalesce("value", "initial")).drop("initial")


def current(changes: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """The latest value per key, whatever order the changes arrived in."""
    return changes.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("current"), F.max(order[0]).alias("since"))


def superseded(changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every old value per key, in distinct rows."""
    return changes.select(*keys, F.col(value).alias("stale")).distinct()


def members(rows: DataFrame, group: str, member: str, low: int = 1, high: int | None = None) -> DataFrame:
    """(group, member) of the groups whose distinct size lies in low..high. Groups are counted before
    members are joined back, so no large set is gathered."""
    m = rows.select(group, member).distinct()
    n = m.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    n = n.where(F.col("n") >= low) if high is None else n.where(F.col("n").between(low, high))
    return m.join(n, group)


def first_and_last(rows: DataFrame, key: str, day: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("n"))
