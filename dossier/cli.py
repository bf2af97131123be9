"""Command line: python -m dossier.cli {init,sweep,context,eval,nightly,digest,consolidate} ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import api
from .config import VaultConfig
from .operators import evalkit as E
from .session import get_spark

CONFIG = os.path.expanduser("~/.config/dossier/config.json")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dossier")
    p.add_argument("--config", default=CONFIG)
    p.add_argument("--master")
    s = p.add_subparsers(dest="cmd", required=True)
    a = s.add_parser("init")
    a.add_argument("vault")
    a.add_argument("--force", action="store_true")
    a = s.add_parser("sweep")
    a.add_argument("--if-changed", metavar="STAMP")
    a.add_argument("--unsourced", action="store_true")
    a.add_argument("--lock", default=os.path.expanduser("~/.cache/dossier/sweep.lock"))
    a = s.add_parser("context")
    a.add_argument("question", nargs="+")
    a.add_argument("--budget", type=int, default=4000)
    e = s.add_parser("eval").add_subparsers(dest="what", required=True)
    a = e.add_parser("check")
    a.add_argument("questions")
    a.add_argument("corpora")
    a.add_argument("--freeze", action="store_true")
    a = e.add_parser("run")
    a.add_argument("questions")
    a.add_argument("corpora")
    a.add_argument("--k", type=int, default=5)
    a.add_argument("--split")
    a.add_argument("--out")
    a = e.add_parser("score-answers")
    a.add_argument("questions")
    a.add_argument("answers")
    a = s.add_parser("nightly")
    a.add_argument("--out", required=True)
    a.add_argument("--apply", action="store_true")
    a.add_argument("--questions")
    a.add_argument("--corpora")
    a.add_argument("--stale-days", type=int, default=90)
    a = s.add_parser("digest")
    a.add_argument("corpora")
    a.add_argument("out")
    a.add_argument("--corpus", action="append")
    a = s.add_parser("consolidate")
    a.add_argument("--state", required=True, help="folder of the state table")
    a.add_argument("--stale-days", type=int, default=30)
    return p


def _json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.cmd == "init":
        api.init(a.vault, a.config, a.force)
        print(f"wrote {a.config}")
        return 0
    spark, cfg, home = get_spark(a.master), VaultConfig.from_file(a.config), os.path.expanduser("~")
    if a.cmd == "sweep" and a.unsourced:
        for r in api.unsourced(spark, cfg).toLocalIterator():
            print(f"{r['card']}: {r['line']}")
    elif a.cmd == "sweep":
        print(" ".join(f"{k}={v}" for k, v in api.sweep(spark, cfg, home=home, if_changed=a.if_changed, lock=a.lock).items()))
    elif a.cmd == "context":
        for r in api.context(spark, cfg, a.question, a.budget).orderBy("qid").toLocalIterator():
            print(r["context"])
    elif a.cmd == "eval" and a.what == "check":
        q = api.load_questions(spark, a.questions)
        errs = api.eval_check(spark, q, _json(a.corpora), a.questions + ".frozen", a.freeze, home)
        for e in errs:
            print("ERROR " + e)
        print(f"{len(errs)} errors")
        return 1 if errs else 0
    elif a.cmd == "eval" and a.what == "run":
        rows, s = api.eval_run(spark, api.load_questions(spark, a.questions), _json(a.corpora), a.k, a.split, home=home)
        if a.out:
            rows.write.mode("overwrite").json(a.out)
        print(E.summary_markdown(s, a.k))
    elif a.cmd == "eval":
        answers = spark.read.schema("id string, answer string").json(a.answers)
        for r in api.eval_score_answers(api.load_questions(spark, a.questions), answers).collect():     # category rows
            print(f"{r['category']}: {r['right']}/{r['n']}")
    elif a.cmd == "nightly":
        q = api.load_questions(spark, a.questions) if a.questions else None
        print(json.dumps(api.nightly(spark, cfg, a.out, stale_days=a.stale_days, apply=a.apply, questions=q,
                                     corpora=_json(a.corpora) if a.corpora else None, home=home)))
    elif a.cmd == "digest":
        from datetime import datetime

        from .sources.sinks import write_digests
        write_digests(api.digest_build(spark, _json(a.corpora), a.corpus, home), a.out, datetime.now().strftime("%Y%m%dT%H%M%S"))
    elif a.cmd == "consolidate":
        state = spark.read.schema("card string, digest string").parquet(a.state) if os.path.isdir(a.state) \
            else spark.createDataFrame([], "card string, digest string")
        for r in api.consolidate_lint(spark, cfg, state, stale_days=a.stale_days).toLocalIterator():
            print(f"{r['problem']}: {r['card']} {r['detail']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
