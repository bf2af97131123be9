"""As-of values, current and outdated values, set members, and first and last dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..sources.tables import table
from .registry import query


@query("""select e.event_id, e.user_id, p.value as value from (select * from events where event_type = 'error') e
asof left join (select user_id, ts, value from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts >= p.ts""")
def asof_value(spark, sf):
    """The last purchase value of the user at each error."""
    e = table(spark, sf, "events")
    probes = e.where("event_type = 'error'").select("user_id", "event_id", "ts")
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), "value")
    return H.as_of(probes, bought, ["user_id"], "ts", "bought", "value", F.date_trunc("day", "at")).select("event_id", "user_id", "value")


@query("""with c as (select user_id, ts, value as new, coalesce(lag(value) over (partition by user_id order by ts, event_id), 0) as old from events where event_type = 'purchase'),
f as (select user_id, min_by(old, ts) as initial from c group by 1)
select e.event_id, coalesce(c.new, f.initial) as value from (select * from events where event_type = 'click') e
asof left join c on e.user_id = c.user_id and e.ts >= c.ts left join f on f.user_id = e.user_id""")
def value_on_day(spark, sf):
    """What a user's purchase value was at each click: the change before it, or the value the first
    change replaced."""
    from ..operators import skew as S

    e = table(spark, sf, "events")
    p = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.col("value").alias("new")).withColumn("slice", F.date_trunc("day", "ts"))
    p = S.carry_last(p, ["user_id"], "slice", ["ts", "event_id"], "new", "old", inclusive=False)
    changes = p.select("user_id", F.coalesce("old", F.lit(0.0)).alias("old"), "new", F.col("ts").alias("day"))
    probes = e.where("event_type = 'click'").select("user_id", "event_id", F.col("ts").alias("at_click"))
    return H.value_at(probes, changes, ["user_id"], "at_click", F.date_trunc("day", "at")).select("event_id", "value")


@query("select o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) as current, strftime(max(o_orderdate), '%Y-%m-%d') as since from orders group by 1")
def current_value(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    return H.current(o, ["o_custkey"], "o_orderstatus", "o_orderdate", "o_orderkey").withColumn("since", F.date_format("since", "yyyy-MM-dd"))


@query("""with o as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r, first_value(o_orderstatus) over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as cur from orders)
select distinct o_custkey, o_orderstatus as stale from o where o_orderstatus <> cur""")
def stale_values(spark, sf):
    """Order states a customer had that are not the current one."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    now = H.current(o, ["o_custkey"], "o_orderstatus", "o_orderdate", "o_orderkey")
    s = H.superseded(o, ["o_custkey"], "o_orderstatus").join(now, "o_custkey")
    return s.where("stale <> current").select("o_custkey", "stale")


@query("""with s as (select l_partkey, max_by(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) as owner from lineitem group by 1)
select l_partkey, s_name as owner, n_name as city from s join supplier on s_suppkey = owner join nation on n_nationkey = s_nationkey""")
def multihop_two_fact(spark, sf):
    """Where the current supplier of each part is: two facts in two tables."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    now = H.current(li, ["l_partkey"], "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber").select("l_partkey", F.col("current").alias("s_suppkey"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return now.join(s, "s_suppkey").join(n, "s_nationkey").select("l_partkey", F.col("s_name").alias("owner"), F.col("n_name").alias("city"))


@query("""with m as (select distinct n_name, s_name from supplier join nation on s_nationkey = n_nationkey), c as (select n_name, count(*) as n from m group by 1 having count(*) between 2 and 5)
select n_name, s_name, n from m join c using (n_name)""")
def aggregate_members(spark, sf):
    """Suppliers of the nations that have two to five."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = table(spark, sf, "supplier").select("s_nationkey", "s_name").join(n, "s_nationkey")
    return H.members(s, "n_name", "s_name", 2, 5)


@query("select user_id, strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day, count(*) as n from events group by 1")
def temporal_first_last(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return H.first_and_last(e, "user_id", "day")
