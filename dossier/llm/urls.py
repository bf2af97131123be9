"""URL filter in DataFrame operations only: rules first, then trust and distrust spread over the graph of hosts.

Rules are (host, path) prefixes; the longest that fits a url decides. Pages that no rule fits take their host's verdict:
personalised PageRank spreads trust along links from hosts whose pages are mostly allowed, and distrust against the links to hosts
that link to mostly blocked ones; a host is blocked if its distrust exceeds its trust by a factor. Edges are links between
hosts in the pages' html and, as a site answers for its parts, host to parent domain and back. Every ancestor of a host down to two
labels is a node, with pages or without, so hosts of one domain are connected. Hosts and edges stay tables.

Both ranks are taken to their fixed point: what still moves is added round by round until it sums to less than a millionth of all
rank, whatever the distance between a host and the seeds. A job does eight rounds.

A null url, or one without `://`, has an empty host and path, fits no rule and is allowed. Null html has no links. Repeated pages
each give a row and their links count each time. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, small, stored

# The rules of the contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

DAMPING = 0.85
SETTLED = 1e-6      # rank that may still be on its way at the end, of 1 in all
AT_ONCE = 8         # rounds of one job
MOST_ROUNDS = 240   # 0.85^240 is far below SETTLED
MAJORITY = 0.5      # share of a host's pages that makes it a seed
FACTOR = 1.0        # blocked if distrust > FACTOR * trust
PARENT = 0.1        # weight of the edges to and from a parent domain, in links

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column | str) -> Column:
    """After the first :// up to / ? # or the end, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column | str) -> Column:
    """What follows the host up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, from columns host and path."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for h, p, _ in ordered]
    def pick(values):
        return F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)])
    return pick([h + p for h, p, _ in ordered]), pick([v for _, _, v in ordered])


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """src, dst, weight: links between different hosts. A link without a host of its own stays on its page's host."""
    found = pages.where(F.contains(html, F.lit("//"))).select(host(url).alias("src"), F.explode(F.regexp_extract_all(
        html, F.lit(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^\s"'>]++)"""), 1)).alias("to"))
    to = F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    return found.select("src", host(to).alias("dst")).where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")) \
        .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def parents(names: DataFrame) -> DataFrame:
    """src, dst, weight: every host and ancestor of more than two labels with the domain it is part of. Addresses in numbers are no
    names and have none."""
    named = names.where(~F.col("host").rlike(r"^(\[.*|[0-9.]+(:[0-9]*)?)$")).select(F.split("host", r"\.").alias("labels"), F.size(F.split("host", r"\.")).alias("n"))
    cuts = F.when(F.col("n") > 2, F.sequence(F.lit(1), F.greatest(F.col("n") - 2, F.lit(1))))
    cut = named.select("labels", "n", F.explode(cuts).alias("i"))
    def tail(i):
        return F.array_join(F.slice("labels", i, F.col("n")), ".")
    return cut.select(tail(F.col("i")).alias("src"), tail(F.col("i") + 1).alias("dst")).distinct().withColumn("weight", F.lit(PARENT))


def _spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """way, host, rank: personalised PageRank along edges(way, src, dst, share) from seeds(way, host, seed), whose seeds sum to 1 for
    each way; the ways do not mix. Mass at hosts without edges returns to nobody, so ranks of two ways compare directly."""
    with scratch(edges.sparkSession) as keep:
        return keep(_fixed_point(edges, seeds), "ranks")


def _fixed_point(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    first = (1 - DAMPING) * F.col("seed")
    state = stored(seeds.select("way", "host", first.alias("rank"), first.alias("fresh")), "ranks")
    # an edge of share 0 from every host to itself carries its rank along, so a round reads the state once
    hosts = edges.select("way", F.col("dst").alias("host")).union(seeds.select("way", "host")).distinct()
    steps = edges.select(F.col("way").alias("along"), "src", "dst", "share").where(F.col("src") != F.col("dst")) \
        .unionByName(hosts.select(F.col("way").alias("along"), F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(0.0).alias("share")))
    steps = small(stored(steps, "steps"))
    for _ in range(MOST_ROUNDS // AT_ONCE):
        for _ in range(AT_ONCE):
            moved = state.join(steps, (F.col("way") == F.col("along")) & (F.col("host") == F.col("src"))).select(
                "way", F.col("dst").alias("host"), F.when(F.col("src") == F.col("dst"), F.col("rank")).otherwise(0.0).alias("rank"),
                (DAMPING * F.col("fresh") * F.col("share")).alias("fresh"))
            # rounded to a fixed scale, so that the order of summation cannot show
            fresh = F.sum(F.col("fresh").cast("decimal(30,15)")).cast("double")
            state = moved.groupBy("way", "host").agg((F.max("rank") + fresh).alias("rank"), fresh.alias("fresh"))
        state = stored(state, "ranks")
        if (state.groupBy("way").agg(F.sum("fresh").alias("left")).agg(F.max("left")).first()[0] or 0.0) < SETTLED:
            return state.select("way", "host", "rank")
    raise RuntimeError("ranks did not settle")


def verdicts(pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """id, host, path, rule, verdict: one row per page."""
    by_rule, says = rule(rules)
    judged = pages.select(id_, host(url).alias("host"), path(url).alias("path")).withColumns({"rule": by_rule, "said": says})
    counts = stored(judged.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == "allow").alias("allowed"),
                                                                 F.count_if(F.col("said") == "block").alias("blocked")), "hosts")
    cross = stored(links(pages, url, html), "links")
    names = stored(counts.select("host").union(cross.select("src")).union(cross.select("dst")).distinct(), "names")
    up = stored(parents(names), "parents")
    all_ = [cross, up, up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")]
    edges = stored(reduce(DataFrame.unionByName, all_).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")

    def shares(way: str, a: str, b: str) -> DataFrame:
        out = small(stored(edges.groupBy(a).agg(F.sum("weight").alias("all")), "out"))
        return edges.join(out, a).select(F.lit(way).alias("way"), F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("weight") / F.col("all")).alias("share"))

    def seeds(way: str, column: str) -> DataFrame:
        chosen = counts.where(F.col(column) > MAJORITY * F.col("n")).select("host", F.col(column).cast("double").alias("w"))
        whole = chosen.agg(F.sum("w").alias("all"))      # one row
        return chosen.join(F.broadcast(whole)).select(F.lit(way).alias("way"), "host", (F.col("w") / F.col("all")).alias("seed"))

    ranks = _spread(stored(shares("trust", "src", "dst").unionByName(shares("distrust", "dst", "src")), "shares"),
                    stored(seeds("trust", "allowed").unionByName(seeds("distrust", "blocked")), "seeds"))
    trust = ranks.where("way = 'trust'").select("host", F.col("rank").alias("trust"))
    distrust = ranks.where("way = 'distrust'").select("host", F.col("rank").alias("distrust"))
    bad = distrust.join(trust, "host", "left").where(F.col("distrust") > FACTOR * F.coalesce("trust", F.lit(0.0))).select("host", F.lit(True).alias("bad"))
    out = judged.join(small(stored(bad, "bad")), "host", "left")
    verdict = F.coalesce("said", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select(id_, "host", "path", "rule", verdict.alias("verdict"))
