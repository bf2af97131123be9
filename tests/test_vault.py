"""A small vault end to end: sources, cards, refresh, retrieval, evaluation, lint."""

import json
import os

import pytest

from dossier import api
from dossier.config import VaultConfig
from dossier.functions import fixed as X

NOTES = {
    "People/Mia Holt.md": "---\nname: Mia Holt\ncontext: runs the pottery studio\n---\nMet at the river market.\n",
    "People/Otto Brandt.md": "Otto keeps bees and sells honey on Fridays.\n",
    "Projects/Blue-Heron.md": "---\ntitle: Blue Heron\ncreated: 2026-03-01\n---\nA tide sensor. Mia Holt owns it.\n",
    "Projects/Blue-Heron-Firmware.md": "---\ndate: 2026-03-04\n---\nFirmware notes.\n",
    "Daily/2026-03-02.md": "**9:15 Blue heron kickoff** `#log`\n\nMia said the board works.\n\n**10:30 Lunch**\n\nNobody of note.\n\n"
                           "**11:00 Reading**\n\nBrandt Y, Cole N. A bibliography line.\n",
    "Resources/Reading.md": "---\ndate: 2026-03-05\n---\nBrandt Y, Cole N. list; later Brandt wants a copy.\nSee [[Projects/Blue-Heron|bird]].\n",
    "Resources/Leak.md": "---\ndate: 2026-03-06\n---\nBlue Heron key " + "aB3" * 14 + "\n",
    "Private/key.md": "Mia Holt secret\n",
    "cards/_registry.md": "## person\n- Otto Brandt: Otto, Brandt\n\n## harness\n- tided: tided, tide daemon\n",
}
REPORT = "---\n---\nLane report\n\ntided restarted; Blue Heron untouched.\n"


def put(root, files):
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8") as f:
            f.write(text)


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    home = str(tmp_path_factory.mktemp("home"))
    vault = os.path.join(home, "vault")
    put(vault, NOTES)
    put(os.path.join(home, "reports"), {"lane-2026-03-07.md": REPORT})
    rec = lambda k, t, ts, src, **x: json.dumps({"kind": k, "text": t, "ts": ts, "src": src, **x}) + "\n"
    put(os.path.join(home, "digests"), {
        "p/s1.jsonl": rec("session", "Sensor work", "2026-03-08T14:00:00Z", "s:p/s1", title="Sensor work", cwd="/tmp/x")
        + rec("prompt", "Fix the Blue Heron build", "2026-03-08T14:05:00Z", "s:p/s1#L3") + rec("reply", "Asked Mia Holt too.", "", "s:p/s1#L4"),
        "p/s1/subagents/a.jsonl": rec("session", "", "2026-03-08T14:07:00Z", "s:p/s1/subagents/a")
        + rec("prompt", "Review Blue Heron tests", "2026-03-08T14:07:00Z", "s:p/s1/subagents/a#L1"),
        "p/s2.jsonl": rec("session", "Other", "2026-03-08T15:00:00Z", "s:p/s2", title="Other", cwd="/tmp") + rec("reply", "Blue Heron is fine.", "", "s:p/s2#L2")})
    cfg = VaultConfig.from_dict({
        "vault": vault, "audit": os.path.join(home, "reports"), "session_digests": os.path.join(home, "digests"), "skip_dirs": ["Private"],
        "person_dirs": ["People"], "project_dirs": ["Projects"], "block_dirs": ["Daily/"]})
    return home, vault, cfg


def card(vault, kind, slug):
    with open(os.path.join(vault, "cards", kind, slug + ".md"), encoding="utf-8") as f:
        return f.read()


def test_sweep_context_and_refresh(spark, place):
    home, vault, cfg = place
    got = api.sweep(spark, cfg, "2026-03-10", home)
    assert got["entities"] == 4 and got["cards"] == 4
    mia, heron, otto, tided = (card(vault, *x) for x in (("person", "mia-holt"), ("project", "blue-heron"), ("person", "otto-brandt"), ("harness", "tided")))
    assert "2026-03-02 9:15 · [[Daily/2026-03-02|2026-03-02]] · Blue heron kickoff: Mia said the board works." in mia
    assert "- One line: runs the pottery studio [source: People/Mia Holt.md; added: 2026-03-10]" in mia
    assert "(defining note)" in heron and heron.count("Blue-Heron-Firmware|") >= 1          # a-b folds into a
    assert "· [[Resources/Leak|Leak]] · Leak <!--k:" in heron                                # entry kept, excerpt dropped
    assert "aB3aB3" not in heron and "Private" not in mia
    assert "[[Resources/Reading|Reading]] · Reading: See bird. <!--k:" in heron
    assert "Resources/Reading" in otto and "2026-03-02" not in otto.split("## Timeline")[1].replace("2026-03-10", "")
    assert "`~/reports/lane-2026-03-07.md`" in tided and "`~/reports/lane-2026-03-07.md`" in heron
    assert "2026-03-08 14:05 · `~/digests/p/s1.jsonl` · Sensor work: Fix the Blue Heron build · from `s:p/s1#L3` <!--k:" in heron
    assert heron.count("s:p/s1") == 1 and "s:p/s2" not in heron
    catalog = open(os.path.join(vault, "cards", "_catalog.md"), encoding="utf-8").read()
    assert "[[cards/project/blue-heron|Blue-Heron]]" in catalog

    again = api.sweep(spark, cfg, "2026-03-11", home)
    assert again["changed"] == 0 and not again["catalog_changed"]

    ctx = api.context(spark, cfg, ["Who owns Blue Heron?", "Where is the river market?"], 400).collect()
    texts = {r["qid"]: r["context"] for r in ctx}
    assert "blue-heron.md] Blue-Heron (project)" in texts["0"] and "Mia Holt owns it" in texts["0"]
    assert "river market" in texts["1"]
    assert all((len(t) + 3) // 4 <= 400 for t in texts.values())

    # owned text survives; a gone report stays, marked; a new capture appears
    p = os.path.join(vault, "cards", "project", "blue-heron.md")
    edited = heron.replace("- Open: \n", "- Open: ship by Friday\n")
    with open(p, "w", encoding="utf-8") as f:
        f.write(edited)
    os.remove(os.path.join(home, "reports", "lane-2026-03-07.md"))
    with open(os.path.join(vault, "Daily/2026-03-02.md"), "a", encoding="utf-8") as f:
        f.write("\n**12:00 Blue Heron shipped**\n\nDone.\n")
    third = api.sweep(spark, cfg, "2026-03-12", home)
    after = card(vault, "project", "blue-heron")
    assert third["kept_gone"] == 2 and third["unsourced"] == 1
    assert "- Open: ship by Friday" in after and "Blue Heron shipped" in after and "(source gone) <!--k:" in after
    assert after.split(X.START)[0].split("---\n", 2)[2] == edited.split(X.START)[0].split("---\n", 2)[2]
    assert [(r["card"], r["line"]) for r in api.unsourced(spark, cfg).collect()] == [("project/blue-heron.md", "- Open: ship by Friday")]


def test_stamp_skips_unchanged_input(spark, place, tmp_path):
    home, vault, cfg = place
    stamp = str(tmp_path / "stamp")
    assert "skipped" not in api.sweep(spark, cfg, "2026-03-12", home, if_changed=stamp)
    assert api.sweep(spark, cfg, "2026-03-12", home, if_changed=stamp) == {"skipped": True}


def test_unreadable_folder_stops_the_listing(place):
    from dossier.sources.vault import list_vault

    with pytest.raises(OSError):
        list_vault("/nonexistent-vault", set(), set(), "cards")


def test_eval_over_corpora(spark, tmp_path):
    root = str(tmp_path / "c")
    put(root, {"a.md": "The heron nests in April.\nHeron heron.\n", "b.md": "Bees swarm in May.\n", "c.txt": "heron", "old/d.md": "heron archive\n"})
    corpora = {"n": {"root": root, "include": ["*.md"], "exclude": ["old/*"]}}
    base = {"as_of": "2026-03-01", "note": "", "split": "frozen"}
    qs = [dict(base, id="q1", category="single", question="When does the heron nest?", answer="April", keys=["April|4th month"], gold=["n:a.md"]),
          dict(base, id="q2", category="abstention", question="Where do owls sleep?", answer="", keys=[], gold=[]),
          dict(base, id="q3", category="temporal", question="When do bees swarm?", answer="May", keys=["May"], gold=["n:b.md"], split="heldout")]
    path = str(tmp_path / "q.jsonl")
    with open(path, "w") as f:
        f.writelines(json.dumps(q) + "\n" for q in qs)
    q = api.load_questions(spark, path)
    stamp = path + ".frozen"
    assert api.eval_check(spark, q, corpora, stamp, freeze=True) == []
    rows, s = api.eval_run(spark, q, corpora)
    got = {r["category"]: (r["n"], r["scored"], r["hits"], r["mrr"]) for r in s.collect()}
    assert got["all"] == (3, 2, 2, 1.0) and got["abstention"][1] == 0
    bad = [dict(qs[0], keys=["June"], gold=["n:a.md", "n:zz.md", "n:old/d.md"]), dict(qs[0], category="odd", split="x"),
           dict(qs[1], keys=["k"]), dict(qs[2], gold=[]), {"id": "q9"}, dict(qs[2], id="q7", keys=["bees"])]
    with open(path, "w") as f:
        f.writelines(json.dumps(b) + "\n" for b in bad)
    errs = api.eval_check(spark, api.load_questions(spark, path), corpora, stamp)
    for want in ("q1: duplicate id", "q1: key June not in any gold source", "q1: gold n:zz.md does not exist", "q1: gold n:old/d.md is excluded",
                 "q1: unknown category odd", "q1: unknown split x", "q2: abstention must have no gold and no keys", "q3: needs gold and keys",
                 "q7: key bees appears in the question"):
        assert want in errs, (want, errs)
    assert any(e.startswith("q9: missing category") for e in errs) and errs[-1].startswith("frozen questions changed")
    ans = spark.createDataFrame([("q1", "in april"), ("q2", "No record of that."), ("q3", "June")], "id string, answer string")
    sc = {r["category"]: (r["right"], r["n"]) for r in api.eval_score_answers(spark.createDataFrame(
        [(x["id"], x["category"], x["keys"]) for x in qs], "id string, category string, keys array<string>"), ans).collect()}
    assert sc == {"single": (1, 1), "abstention": (1, 1), "temporal": (0, 1), "all": (2, 3)}


def test_lock_lets_one_sweep_run(spark, place, tmp_path):
    import fcntl

    home, vault, cfg = place
    lock = str(tmp_path / "sweep.lock")
    with open(lock, "w") as held:
        fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
        assert api.sweep(spark, cfg, "2026-03-12", home, lock=lock) == {"locked": True}


def test_digest_build_archives_and_skips_unchanged(spark, tmp_path):
    from dossier.sources import sinks, vault

    root, out = str(tmp_path / "c"), str(tmp_path / "out")
    msg = lambda c: json.dumps({"type": "user", "timestamp": "2026-03-01T10:00:00Z", "sessionId": "S", "message": {"role": "user", "content": c}}) + "\n"
    put(root, {"s.jsonl": msg("first question") + msg("second question"), "hidden.jsonl": msg("x") + msg("DO NOT INDEX THIS CHAT"), "n.md": "# H 2026-01-02\nbody\n"})
    corpora = {"c": {"root": root, "include": ["*.md", "*.jsonl"]}}
    d = api.digest_build(spark, corpora)
    lines = {(r["path"], json.loads(r["line"])["kind"], json.loads(r["line"])["text"]) for r in d.collect()}
    assert ("c:s.jsonl", "prompt", "first question") in lines and ("c:n.md", "section", "body") in lines
    assert {x for x in lines if x[0] == "c:hidden.jsonl"} == {("c:hidden.jsonl", "session", "not indexed (marker)")}
    sinks.write_digests(d, out, "run1")
    put(root, {"s.jsonl": msg("second question")})
    sinks.write_digests(api.digest_build(spark, corpora), out, "run2")
    gone = spark.read.parquet(os.path.join(out, "archive", "run2"))
    assert {r["path"] for r in gone.select("path").distinct().collect()} == {"c:s.jsonl"} and "first question" in "".join(r["line"] for r in gone.collect())
    done = vault.read_corpora(spark, corpora).selectExpr("concat(corpus, ':', rel) as ref", "mtime")
    assert api.digest_build(spark, corpora, done=done).count() == 0


def test_nightly_gate(spark, place, tmp_path):
    home, vault, cfg = place
    p = os.path.join(vault, "cards", "harness", "tided.md")
    with open(p, encoding="utf-8") as f:
        text = f.read()
    dup = "- State: daemon restarts cleanly each night [source: Resources/Reading.md; added: 2026-03-01]\n"
    with open(p, "w", encoding="utf-8") as f:
        f.write(text.replace("- Open: \n", dup + dup))
    qs = [{"id": "q1", "category": "single", "question": "Which daemon restarts cleanly?", "answer": "tided", "keys": ["tided"], "gold": ["cards:harness/tided.md"],
           "as_of": "", "split": "frozen", "note": ""}]
    path = str(tmp_path / "q.jsonl")
    with open(path, "w") as f:
        f.writelines(json.dumps(q) + "\n" for q in qs)
    out = str(tmp_path / "nightly")
    seen = api.nightly(spark, cfg, out, "2026-03-12", questions=api.load_questions(spark, path), home=home)
    assert seen["decision"] == "proposed" and seen["findings"]["exact_dup"] == 1
    did = api.nightly(spark, cfg, out, "2026-03-12", apply=True, questions=api.load_questions(spark, path), home=home)
    assert did["decision"] == "applied" and did["written"] == 1 and did["skipped"] == 0
    with open(p, encoding="utf-8") as f:
        assert f.read().count("daemon restarts cleanly") == 1
    assert len(open(os.path.join(out, "ledger.jsonl")).read().splitlines()) == 2


def test_embed_sends_each_text_once(spark):
    from dossier.operators.retrievers import embed

    t = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a")], "doc long, text string")
    v = embed(t, lambda xs: [[float(len(x)), 1.0] for x in xs])
    got = {r["doc"]: r["embedding"] for r in v.collect()}
    assert got == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0]}
    assert embed(t, lambda xs: 1 / 0, stored=v.select("sha", "embedding").distinct()).count() == 3
