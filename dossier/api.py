"""What a user runs on a real folder: sweep, context, eval, nightly, digest, consolidate."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import VaultConfig
from .functions import fixed as X
from .functions import text as T
from .operators import cards as C
from .operators import digest as D
from .operators import entities as En
from .operators import evalkit as E
from .operators import facts as Fa
from .operators import lint as L
from .operators import parse as P
from .operators import rank as R
from .operators import skew as S
from .operators import timeline as TL
from .session import cut
from .sources import sinks as K
from .sources import vault as V


# ---- index -------------------------------------------------------------------------------------

def init(vault: str, path: str, force: bool = False) -> VaultConfig:
    """Write a config with the folder roles found in a vault."""
    cfg = VaultConfig.infer(os.path.abspath(os.path.expanduser(vault)))
    if os.path.exists(path) and not force:
        raise FileExistsError(path)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({k: list(v) if isinstance(v, tuple) else v for k, v in vars(cfg).items() if v and k != "pruned"}, f, indent=1)
    return cfg


def card_entries(cards: DataFrame) -> DataFrame:
    """timeline rows parsed back from cards(slug, text). A card that continues in numbered files is one card."""
    cards = cards.withColumn("slug", F.regexp_replace("slug", r"\.\d+$", ""))
    inner = F.split(F.split(F.col("text"), X.START, 2)[1], X.END, 2)[0]
    lines = cards.where(F.contains("text", F.lit(X.START))).select("slug", F.explode(F.split(inner, "\n")).alias("line"))
    return TL.parse_card_lines(lines)


def sweep(spark: SparkSession, cfg: VaultConfig, today: str | None = None, home: str = "", dictionary: DataFrame | None = None,
          if_changed: str | None = None, lock: str | None = None) -> dict:
    """Build or refresh every card. `if_changed` names a stamp file: nothing happens unless an input is
    newer than the start of the last sweep. `lock` names a file that lets one sweep run at a time; a second
    one does nothing. Returns counters."""
    if lock:
        import fcntl

        os.makedirs(os.path.dirname(lock) or ".", exist_ok=True)
        with open(lock, "a") as held:
            try:
                fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                return {"locked": True}
            return sweep(spark, cfg, today, home, dictionary, if_changed)
    t0, today = time.time(), today or date.today().isoformat()
    if if_changed and os.path.exists(if_changed):
        with open(if_changed, encoding="utf-8") as f:
            if V.newest_input(cfg, home) <= float(f.read() or 0):
                return {"skipped": True}
    notes = P.with_frontmatter(V.read_vault(spark, cfg, home)).persist()
    ents = cut(En.discover(notes, cfg, V.read_registry(cfg), dictionary))
    found = TL.collect(notes, ents, cfg)
    if cfg.session_digests:
        found = found.unionByName(TL.collect_sessions(V.read_sessions(spark, cfg, home), ents, cfg.timezone))
    old = V.read_cards(spark, cfg).persist()
    merged = cut(TL.merge(cut(found), card_entries(old), V.list_paths(spark, cfg, home)))
    first_files = old.where(~F.col("slug").rlike(r"\.\d+$"))
    cards = cut(K.render_cards(merged, ents, first_files, K.seeds(notes, ents, today), cfg))
    name = F.concat("kind", F.lit("/"), "slug", F.when(F.col("part") > 0, F.concat(F.lit("."), (F.col("part") + 1).cast("string"))).otherwise(F.lit("")), F.lit(".md"))
    wrote = K.write_texts(cards.select(name.alias("rel"), "text"), old.select(F.col("card").alias("rel"), "text"), cfg.cards_root, datetime.now().strftime("%Y-%m-%d %H:%M"))
    moved = old.join(ents.select("slug", F.col("kind").alias("now")), "slug").where("kind <> now").select("card")
    n = wrote.agg(F.count_if("written").alias("changed"), F.count(F.lit(1)).alias("files")).first()
    stale = old.where(F.col("slug").rlike(r"\.\d+$")).join(cards.select(name.alias("card")), "card", "left_anti").select("card")
    for r in moved.unionByName(stale).toLocalIterator():    # cards of entities whose kind changed, and numbered files past a card's end
        os.remove(os.path.join(cfg.cards_root, r["card"]))
    cat = K.write_catalog(TL.catalog(merged, ents), cfg)
    bare = L.unsourced(L.bullets(L.card_lines(cards.select(F.col("slug").alias("card"), "text")).where("fact"))).count()
    out = {"entities": ents.count(), "cards": cards.select("slug").distinct().count(), "changed": n["changed"], "kept_gone": merged.where("gone").count(),
           "sources": notes.count(), "unsourced": bare, "catalog_changed": cat, "seconds": round(time.time() - t0, 1)}
    notes.unpersist()
    old.unpersist()
    if if_changed:
        with open(if_changed, "w", encoding="utf-8") as f:
            f.write(repr(t0))
    return out


def unsourced(spark: SparkSession, cfg: VaultConfig) -> DataFrame:
    """(card, line) of agent-written bullets without source and date."""
    return L.unsourced(L.bullets(L.card_lines(V.read_cards(spark, cfg)).where("fact"))).select("card", "line")


# ---- retrieval ---------------------------------------------------------------------------------

def load_chunks(spark: SparkSession, cfg: VaultConfig) -> DataFrame:
    """chunks of the vault's notes, numbered in (path, no) order."""
    c = P.chunks(V.read_vault(spark, cfg).where("in_vault"), cfg.block_dirs)
    return cut(c.orderBy("path", "no").withColumn("chunk", F.monotonically_increasing_id()))


def card_index(spark: SparkSession, cfg: VaultConfig, chunks: DataFrame) -> C.CardIndex:
    cards = cut(V.read_cards(spark, cfg))
    fm = P.frontmatter("text")
    found = F.regexp_extract_all(F.coalesce(P.fm_get(fm, "aliases"), F.lit("")), F.lit('"([^"]+)"'), 1)
    name = P.fm_get(fm, "entity")
    al = F.when(F.size(found) > 0, F.transform(found, lambda a: F.struct(a.alias("text"), (a != F.lower(a)).alias("cs")))) \
        .otherwise(F.array(F.struct(name.alias("text"), F.lit(True).alias("cs"))))
    e = cards.where(~F.col("slug").rlike(r"\.\d+$")).select("slug", name.alias("name"), name.alias("display"), "kind", al.alias("aliases"),
                                                            F.array().cast("array<string>").alias("notes"))
    t = card_entries(cards)
    return C.build_index(t, cut(e), chunks, cfg.block_dirs, cfg.cards_folder)


def context(spark: SparkSession, cfg: VaultConfig, questions: list[str], budget: int = 4000) -> DataFrame:
    """(qid, context, ctx_key) for each question, qid being its position."""
    q = spark.createDataFrame([(str(i), x) for i, x in enumerate(questions)], "qid string, question string")
    ch = load_chunks(spark, cfg)
    return C.context_text(C.contexts(q, card_index(spark, cfg, ch), budget))


# ---- evaluation --------------------------------------------------------------------------------

QUESTION = "id string, category string, question string, answer string, keys array<string>, gold array<string>, as_of string, split string, note string"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).json(path)


def eval_check(spark: SparkSession, questions: DataFrame, corpora: dict, stamp: str | None = None, freeze: bool = False, home: str = "") -> list[str]:
    """Errors of a question set, none if it is valid. `stamp` is where the frozen digest is kept."""
    files = V.read_corpora(spark, {n: {"root": c["root"]} for n, c in corpora.items()}, home)
    errs = sorted(f"{r['qid']}: {r['error']}" for r in E.check(questions, files, E.corpora_table(spark, corpora)).toLocalIterator())
    now = (E.frozen_stamp(questions).first() or {"stamp": ""})["stamp"]
    if stamp and freeze and not errs:
        with open(stamp, "w", encoding="utf-8") as f:
            f.write(now + "\n")
    elif stamp and os.path.exists(stamp):
        with open(stamp, encoding="utf-8") as f:
            if f.read().strip() != now:
                errs.append(f"frozen questions changed since {os.path.basename(stamp)} was written")
    return errs


Retrieve = Callable[[DataFrame, DataFrame, int], DataFrame]


def lines_tfidf(files: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The default retriever: (qid, ref, rank) over files(corpus, rel, text)."""
    d = files.select("corpus", F.concat("corpus", F.lit(":"), "rel").alias("doc"), "text")
    return R.tfidf_lines(d, questions, k).select("qid", F.col("doc").alias("ref"), "rank")


def fused(extra: list[Retrieve], depth: int = 10, k: int = X.RRF_K) -> Retrieve:
    """The default retriever fused with others."""
    def run(files, questions, top):
        lists = [r(files, questions, depth).withColumnRenamed("ref", "doc") for r in [lines_tfidf, *extra]]
        return R.rrf(lists, depth, k).where(F.col("rank") <= top).withColumnRenamed("doc", "ref").select("qid", "ref", "rank")
    return run


def external(results: DataFrame) -> Retrieve:
    """Ranked results of another tool, results(qid, file, pos) with `scheme://corpus/path` files: refs in
    order, each once."""
    def run(files, questions, k):
        r = results.select("qid", T.ref_of("file").alias("ref"), "pos").groupBy("qid", "ref").agg(F.min("pos").alias("pos"))
        return S.top_k(r, ["qid"], [F.col("pos"), F.col("ref")], k)
    return run


def eval_run(spark: SparkSession, questions: DataFrame, corpora: dict, k: int = 5, split: str | None = None, retrieve: Retrieve = lines_tfidf,
             home: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of a retriever over a question set."""
    q = questions.where(F.col("split") == split) if split else questions
    q = q.withColumn("qid", F.col("id"))
    rows = E.hit_rows(q, retrieve(V.read_corpora(spark, corpora, home), q, k), k)
    return rows, E.summary(rows)


def eval_score_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(category, right, n) per category and for all. answers(id, answer)."""
    s = E.key_scores(questions.withColumn("qid", F.col("id")), answers.withColumnRenamed("id", "qid"))
    return s.rollup("category").agg(F.count_if("correct").alias("right"), F.count(F.lit(1)).alias("n")) \
        .withColumn("category", F.coalesce("category", F.lit("all")))


# ---- maintenance -------------------------------------------------------------------------------

def nightly(spark: SparkSession, cfg: VaultConfig, out: str, today: str | None = None, stale_days: int = 90, apply: bool = False,
            questions: DataFrame | None = None, corpora: dict | None = None, k: int = 5, home: str = "") -> dict:
    """Lint all cards, write the patches, and with `apply` publish the changes if the score of the question
    set does not drop and no owned text is lost. One ledger line per run."""
    t0, today = time.time(), today or date.today().isoformat()
    cards = cut(V.read_cards(spark, cfg).select("card", "text"))
    paths = V.list_paths(spark, cfg, home).select(F.col("rel").alias("path"))
    found = L.analyse(cards, paths, today, stale_days)
    proposed = cut(L.proposals(cards, found))
    L.patches(proposed).select("patch").write.mode("overwrite").text(os.path.join(out, f"patch-{today}"))
    entry = {"date": today, "mode": "apply" if apply else "propose", "cards": cards.count(), "proposed_cards": proposed.count(),
             "findings": {p: found[p].count() for p in X.LINT_PASSES}, "decision": "proposed", "written": 0, "skipped": 0}
    if apply and not entry["proposed_cards"]:
        entry["decision"] = "nothing to apply"
    elif apply:
        after = cards.join(proposed.select("card", "new"), "card", "left").select("card", F.coalesce("new", "text").alias("text"))
        score = lambda c: cut(_card_score(spark, c, questions, corpora, k, home))
        own = lambda d, c: L.card_lines(d.select("card", F.col(c).alias("text"))).where(~F.col("inside"))
        lost = own(proposed, "new").select("card", "line").exceptAll(own(after.join(proposed.select("card"), "card"), "text").select("card", "line"))
        g = L.gate(score(cards), score(after), lost.select("card").distinct()).first()
        entry["decision"] = g["decision"]
        entry["score_before"], entry["score_after"] = {"hits": g["b_hits"], "mrr": g["b_mrr"]}, {"hits": g["a_hits"], "mrr": g["a_mrr"]}
        if g["decision"] == "applied":
            n = K.publish(proposed, cfg.cards_root).agg(F.count_if("written").alias("w"), F.count_if(~F.col("written")).alias("s")).first()
            entry["written"], entry["skipped"] = n["w"], n["s"]
    entry["seconds"] = round(time.time() - t0, 1)
    K.append_ledger(entry, os.path.join(out, "ledger.jsonl"))
    return entry


def _card_score(spark, cards: DataFrame, questions: DataFrame, corpora: dict, k: int, home: str) -> DataFrame:
    files = V.read_corpora(spark, corpora, home).select("corpus", "rel", "text") if corpora else None
    c = cards.select(F.lit("cards").alias("corpus"), F.col("card").alias("rel"), "text")
    q = questions.withColumn("qid", F.col("id"))
    return E.summary(E.hit_rows(q, lines_tfidf(c if files is None else files.unionByName(c), q, k), k))


def prompt_cost(rows: DataFrame, text: str, usd_per_million: float) -> DataFrame:
    """Rows, input tokens and price of showing every row of a column to a model."""
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text) + 1).alias("chars"))
    return s.select("n", F.floor(F.col("chars") / 4).alias("tokens"), (F.floor(F.col("chars") / 4) / 1e6 * usd_per_million).alias("usd"))


# ---- digests and consolidation -----------------------------------------------------------------

def digest_unchanged(spark: SparkSession, corpora: dict, done: DataFrame, names: list[str] | None = None, home: str = "") -> DataFrame:
    """(path): files in done(ref, mtime) that are still there and have not changed since; sinks.write_digests keeps their lines."""
    f = V.read_corpora(spark, {n: v for n, v in corpora.items() if not names or n in names}, home).withColumn("path", F.concat("corpus", F.lit(":"), "rel"))
    seen = done.select(F.col("ref").alias("path"), F.col("mtime").alias("seen"))
    return f.join(seen, "path").where(F.col("seen") >= F.col("mtime")).select("path")


def digest_build(spark: SparkSession, corpora: dict, names: list[str] | None = None, home: str = "", done: DataFrame | None = None) -> DataFrame:
    """(path, place, line, kept) of every session and note of the corpora; see sinks.write_digests. Files in
    done(ref, mtime) that have not changed since are left out."""
    c = {n: v for n, v in corpora.items() if not names or n in names}
    f = V.read_corpora(spark, c, home).withColumn("ref", F.concat("corpus", F.lit(":"), "rel"))
    if done is not None:
        old = done.select("ref", F.col("mtime").alias("seen"))
        f = f.join(old, "ref", "left").where(F.col("seen").isNull() | (F.col("seen") < F.col("mtime"))).drop("seen")
    s = f.where(F.col("rel").endswith(".jsonl"))
    lines = s.select(F.col("ref").alias("session"), F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("n", "raw")) \
        .withColumn("n", (F.col("n") + 1).cast("long"))
    out = D.opted_out(lines)
    r = cut(D.session_records(lines))
    h = D.heads(D.parse_lines(lines.join(out, "session", "left_anti")), s.select(F.col("ref").alias("session")))
    h = h.join(out.withColumn("out", F.lit(True)), "session", "left")
    text = F.when(F.col("out"), F.lit("not indexed (marker)")).otherwise(F.col("text"))
    head_json = T.canonical_json({"kind": F.lit("session"), "text": text, "ts": F.col("ts"), "src": F.col("session"), "id": F.col("id"), "cwd": F.col("cwd"),
                                  "branch": F.col("branch"), "title": F.col("title"), "start": F.col("start"), "end": F.col("end")})
    h = h.select("session", head_json.alias("line"))
    b = D.bound(r, h.select("session", F.length("line").alias("size")))
    zero = D._place(F.lit(0), 0, F.lit(0), 0, F.lit(0))
    body = b.select(F.col("session").alias("path"), F.struct(F.lit(1).alias("t"), F.col("ord").alias("o")).alias("place"), D.json_line(b).alias("line"), "kept")
    head = h.select(F.col("session").alias("path"), F.struct(F.lit(0).alias("t"), zero.alias("o")).alias("place"), "line", F.lit(True).alias("kept"))
    n = D.note_records(f.where(~F.col("rel").endswith(".jsonl")).select("rel", "ref", "text", "mtime"))
    nj = T.canonical_json({"kind": F.col("kind"), "text": F.col("text"), "ts": F.col("ts"), "src": F.col("src"), "heading": F.col("heading")})
    at = D._place(F.col("sec"), 0, F.col("piece"), 0, F.lit(0))
    note = n.select(F.col("ref").alias("path"), F.struct(F.lit(0).alias("t"), at.alias("o")).alias("place"), nj.alias("line"), F.lit(True).alias("kept"))
    return head.unionByName(body).unionByName(note)


def timeline_entries(cards: DataFrame) -> DataFrame:
    """entries(card, ord, k, when, line, rel) of cards(card, text), in card order."""
    inner = F.split(F.split(F.col("text"), X.START, 2)[1], X.END, 2)[0]
    e = cards.where(F.contains("text", F.lit(X.START))).select("card", F.filter(F.split(inner, "\n"), lambda x: F.rlike(x, F.lit(X.ENTRY_KEY))).alias("ls"))
    e = e.select("card", F.posexplode("ls").alias("ord", "line"))
    rel = F.coalesce(F.nullif(F.concat(F.nullif(F.regexp_extract("line", r"\[\[([^|\]]+)\|", 1), F.lit("")), F.lit(".md")), F.lit("")),
                     F.nullif(F.regexp_extract("line", r"`([~/][^`]+)`", 1), F.lit("")))
    return e.select("card", "ord", F.regexp_extract("line", X.ENTRY_KEY, 1).alias("k"),
                    F.regexp_extract("line", r"^- (.*?) · ", 1).alias("when"), "line", rel.alias("rel"))


def consolidate_run(spark: SparkSession, cfg: VaultConfig, state: DataFrame, propose: Callable[[DataFrame, DataFrame], DataFrame], today: str | None = None,
                    only: str | None = None, dry_run: bool = False, home: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Consolidate changed cards with proposed facts; returns (changed, verdicts, new state)."""
    from .config import glob_regex

    cards = V.read_cards(spark, cfg).select("card", "text")
    if only:
        cards = cards.where(F.col("card").rlike(glob_regex(only)))
    cards = cut(cards)
    notes = V.read_vault(spark, cfg, home).select("rel", F.col("text").alias("source_text"))
    e = cut(timeline_entries(cards).join(notes, "rel", "left"))
    changed, verdicts, new_state = Fa.run(cards, e, state, today or date.today().isoformat(), propose)
    changed = cut(changed)
    if not dry_run:
        K.publish(changed, cfg.cards_root).count()
    return changed, verdicts, new_state


def consolidate_lint(spark: SparkSession, cfg: VaultConfig, state: DataFrame, today: str | None = None, stale_days: int = 30) -> DataFrame:
    """(card, problem, detail) over the consolidated summaries."""
    cards = cut(V.read_cards(spark, cfg).select("card", "text"))
    cutoff = (date.fromisoformat(today or date.today().isoformat()) - timedelta(days=stale_days)).isoformat()
    return Fa.lint(Fa.parse_summary(cards), timeline_entries(cards), state, cutoff)
