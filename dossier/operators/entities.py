"""Entity discovery: folder roles and a registry to entities(slug, name, display, kind, aliases, notes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import VaultConfig, glob_regex
from ..functions import fixed as X
from ..functions import text as T
from ..session import kept
from . import parse as P

_ALIASES = "array<struct<text:string,cs:boolean>>"


def _alias(text: Column, cs: Column) -> Column:
    return F.struct(text.alias("text"), cs.alias("cs"))


def _titled(name: Column) -> Column:
    up = F.transform(F.split(name, X.SEPARATOR), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    return F.array_join(up, " ")


def _defines_nothing(rel: Column, globs) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | rel.rlike(glob_regex(g))
    return out


def _person_rows(notes, rel_dir, rank, cfg):
    inside = notes.where((T.dirname("rel") == rel_dir) & ~F.col("rel").isin(list(cfg.skip_files) or [""]))
    stem = F.regexp_replace(T.basename("rel"), r"\.md$", "")
    shown = F.regexp_replace(F.coalesce(F.nullif(P.fm_get("fm", "name"), F.lit("")), stem), r"\s+\d+$", "")
    return inside.select(F.lit(rank).alias("rank"), stem.alias("name"), shown.alias("display"),
                         F.lit("person").alias("kind"), F.col("rel").alias("note"),
                         F.array(_alias(_titled(shown), F.lit(True))).cast(_ALIASES).alias("aliases"))


def _plain_rows(rows: DataFrame, rank: int, kind: Column) -> DataFrame:
    return rows.select(F.lit(rank).alias("rank"), "name", F.lit(None).cast("string").alias("display"),
                       kind.alias("kind"), "note",
                       F.array(_alias(F.col("name"), F.lit(False))).cast(_ALIASES).alias("aliases"))


def _fold_projects(notes: DataFrame, rel_dir: str) -> DataFrame:
    """Notes of a project folder; `a-b` belongs to project `a` when note `a` is there. The possible
    parents of a name are its prefixes at dashes, so this is an equi-join."""
    p = notes.where(T.dirname("rel") == rel_dir) \
        .select(F.col("rel").alias("note"), F.regexp_replace(T.basename("rel"), r"\.md$", "").alias("stem"))
    parts = F.split(F.lower("stem"), "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "-"))
    cand = p.where(F.size(parts) > 1).select("note", "stem", F.explode(prefixes).alias("low"))
    heads = p.select(F.lower("stem").alias("low"), F.col("stem").alias("parent"))
    parents = cand.join(heads, "low").groupBy("note").agg(F.min("parent").alias("parent"))
    return p.join(parents, "note", "left").select(F.coalesce("parent", "stem").alias("name"), "note")


def _subfolders(notes: DataFrame, rel_dir: str, globs) -> DataFrame:
    """Each subfolder is a project; its first note defines it."""
    pre = rel_dir + "/" if rel_dir else ""
    tail = F.substring(F.col("rel"), F.lit(len(pre) + 1), F.length("rel"))
    n = notes.where(F.col("rel").startswith(pre) & F.contains(tail, F.lit("/"))) \
        .withColumn("name", F.split(tail, "/")[0]) \
        .where(~F.col("name").startswith(".") & ~_defines_nothing(F.concat(F.lit(pre), F.col("name")), globs))
    direct = F.when((F.size(F.split(tail, "/")) == 2) & ~_defines_nothing(F.col("rel"), globs), F.col("rel"))
    return n.groupBy("name").agg(F.min(direct).alias("note"))


def registry(text: str, spark) -> DataFrame:
    """registry(name, kind, aliases, ord) from `## kind` sections of `- Name: alias, alias` lines."""
    one = spark.createDataFrame([(text,)], "text string")
    parts = one.select(F.posexplode(F.split(F.concat(F.lit("\n"), T.unix_lines("text")), r"\n(?=##\s+\w)")).alias("s", "part"))
    parts = parts.withColumn("kind", F.lower(F.regexp_extract("part", r"^##\s+(\w+)", 1))).where(F.col("kind").isin(X.KINDS))
    lines = parts.select("s", "kind", F.posexplode(F.split("part", "\n")).alias("l", "line"))
    rx = r"^-\s+([^:]+):\s*(.*)$"
    lines = lines.where(F.col("line").rlike(rx)).select(
        "s", "l", "kind", T.strip(F.regexp_extract("line", rx, 1)).alias("name"),
        F.filter(F.transform(F.split(F.regexp_extract("line", rx, 2), ","), T.strip), lambda a: a != "").alias("al"))
    given = F.transform("al", lambda a: _alias(a, a != F.lower(a)))
    own = F.array(_alias(F.col("name"), F.col("name") != F.lower("name")))
    return lines.select((F.col("s") * 1000000 + F.col("l")).alias("ord"), "name", "kind",
                        F.when(F.size("al") > 0, given).otherwise(own).cast(_ALIASES).alias("aliases"))


def discover(notes: DataFrame, cfg: VaultConfig, registry_text: str = "", dictionary: DataFrame | None = None) -> DataFrame:
    """Entities of a vault. `dictionary(word)` optionally lists common words whose one-word names get
    no alias of their own. The first definer of a slug keeps its kind; the registry overrides."""
    if "fm" not in notes.columns:
        notes = P.with_frontmatter(notes)
    notes = kept(notes.where(F.col("in_vault")).select("rel", "fm"), "definers")     # parsed once, read by every kind of folder
    usable = notes.where(~_defines_nothing(F.col("rel"), cfg.not_entities))
    rank, rows = 0, []
    for d in cfg.person_dirs:
        rows.append(_person_rows(usable, d, rank, cfg))
        rank += 1
    in_dir = lambda d: usable.where(T.dirname("rel") == d).select(
        F.regexp_replace(T.basename("rel"), r"\.md$", "").alias("name"), F.col("rel").alias("note"), "fm")
    for d in cfg.project_dirs:
        rows.append(_plain_rows(_fold_projects(usable, d), rank, F.lit("project")))
        rows.append(_plain_rows(_subfolders(notes, d, cfg.not_entities), rank + 1, F.lit("project")))
        rank += 2
    for d in cfg.root_project_dirs:
        first = in_dir(d).agg(F.min("note").alias("note")).select(F.lit(d).alias("name"), "note")
        rows.append(_plain_rows(first, rank, F.lit("project")))
        rank += 1
    for d in cfg.area_dirs:
        rows.append(_plain_rows(in_dir(d), rank, F.lit("area")))
        rank += 1
    for d in cfg.topic_dirs:
        kind = F.when(P.fm_get("fm", "type") == "project", F.lit("project")).otherwise(F.lit("topic"))
        rows.append(_plain_rows(in_dir(d), rank, kind))
        rank += 1
    for d in cfg.archive_dirs:
        rows.append(_plain_rows(in_dir(d), rank, F.lit("project")))
        rank += 1
    spark = notes.sparkSession
    schema = f"rank int, name string, display string, kind string, note string, aliases {_ALIASES}"
    found = spark.createDataFrame([], schema)
    for r in rows:
        found = found.unionByName(r)
    if dictionary is not None:
        found = _drop_common(found, dictionary)
    found = found.withColumn("slug", T.slugify("name"))
    pos = F.struct("rank", F.coalesce("note", F.lit("")))
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(pos.alias("pos"), F.col("aliases").alias("aliases")))), lambda s: s.aliases))
    ents = found.groupBy("slug").agg(
        F.min_by(F.struct("name", "kind"), pos).alias("head"), F.array_distinct(flat).alias("aliases"),
        F.max_by("display", F.when(F.col("kind") == "person", pos)).alias("display"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("rank", "note")))),
                    lambda s: s.note).alias("notes"))
    ents = ents.select("slug", "head.name", F.coalesce("display", "head.name").alias("display"), "head.kind",
                       "aliases", F.array_distinct("notes").alias("notes"))
    ents = _first_names(ents)
    return _override(ents, registry(registry_text, spark)) if registry_text else ents


def _drop_common(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One-word names that are dictionary words keep their entity but lose the automatic alias."""
    words = dictionary.select(F.lower("word").alias("w")).distinct()
    low = F.lower("name")
    one = (F.size(F.split("name", X.SEPARATOR)) == 1) & (F.col("kind") != "person")
    forms = found.where(one).select("name", F.explode(F.array(low, F.regexp_replace(low, "s+$", ""))).alias("w"))
    common = forms.join(words, "w", "left_semi").select("name").distinct().withColumn("common", F.lit(True))
    return found.join(common, "name", "left").withColumn(
        "aliases", F.when(F.col("common") & one, F.array().cast(_ALIASES)).otherwise(F.col("aliases"))).drop("common")


def _first_names(ents: DataFrame) -> DataFrame:
    """A first name that belongs to one person only, and is no entity itself, becomes an alias."""
    first = F.split(T.strip("name"), r"\s+")[0]
    capital = F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, F.lit(2), F.length(first))))
    people = ents.where((F.col("kind") == "person") & F.contains("name", F.lit(" "))).select("slug", capital.alias("first"))
    only = people.groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.min("slug").alias("slug")).where("n = 1")
    taken = ents.where(F.col("kind") == "person").select(F.col("slug").alias("s"))
    only = only.withColumn("s", T.slugify("first")).join(taken, "s", "left_anti").select("slug", "first")
    extra = F.when(F.col("first").isNotNull(), F.array(_alias(F.col("first"), F.lit(True)))) \
        .otherwise(F.array().cast(_ALIASES))
    return ents.join(only, "slug", "left") \
        .withColumn("aliases", F.concat("aliases", extra.cast(_ALIASES))).drop("first")


def _override(ents: DataFrame, reg: DataFrame) -> DataFrame:
    r = reg.withColumn("slug", T.slugify("name")).groupBy("slug").agg(
        F.min_by("name", "ord").alias("r_name"), F.max_by("kind", "ord").alias("r_kind"),
        F.max_by("aliases", "ord").alias("r_aliases"))
    j = ents.join(r, "slug", "full_outer")
    return j.select("slug", F.coalesce("name", "r_name").alias("name"), F.coalesce("display", "r_name").alias("display"),
                    F.coalesce("r_kind", "kind").alias("kind"), F.coalesce("r_aliases", "aliases").alias("aliases"),
                    F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))
