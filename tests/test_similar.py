"""Set joins by sketches against brute force, and what they write."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.functions import bullets as Bu
from dossier.functions import text as T
from dossier.operators import similar as Sm

SCHEMA = "card string, id long, words array<string>, nkey string"


def made(seed, n, cards=("x", "y", None)):
    """Families of sets: each is a changed copy of one before it, or new; ids and rows repeat now and then."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.7:
            words = set(rng.choice(rows)[2])
            for _ in range(rng.randint(0, 6)):
                words.add(f"w{rng.randint(0, 400)}")
                words.discard(rng.choice(sorted(words)))
        else:
            words = {f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(rng.choice([0, 1, 3, 20, 60, 300]))}
        rows.append((rng.choice(cards), i if rng.random() < 0.9 else i // 2, sorted(words), rng.choice(["", "", "1", "2", None])))
    return rows + rows[:3]


def brute(rows, threshold, differ):
    out = []
    for p in rows:
        for q in rows:
            if p[0] is None or p[0] != q[0] or p[1] >= q[1] or not p[2] or not q[2] or (differ and (p[3] is None or q[3] is None or p[3] == q[3])):
                continue
            both = len(set(p[2]) & set(q[2]))
            j = both / (len(p[2]) + len(q[2]) - both)
            if j >= threshold:
                out.append((p[0], p[1], q[1], round(j, 9), p[3], q[3]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("threshold,differ,block", [(0.8, None, 8192), (0.5, "nkey", 8192), (0.5, "nkey", 16), (0.8, None, 7)])
def test_pairs_are_those_of_brute_force(spark, monkeypatch, threshold, differ, block):
    monkeypatch.setattr(Sm, "BLOCK", block)
    monkeypatch.setattr(Sm, "WHOLE", 50)
    rows = made(int(threshold * 10) + block, 150)
    got = Sm.similar_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), ["card"], "id", "words", threshold, differ=differ, carry=["nkey"])
    got = sorted([(r.card, r.a, r.b, round(r.jaccard, 9), r.a_nkey, r.b_nkey) for r in got.collect()], key=repr)
    assert got == brute(rows, threshold, differ) and got


def test_sets_with_common_words_make_few_candidates(spark):
    """Sets that share a third of their words are not similar at one half, and hardly any pair of them becomes a row."""
    rng = random.Random(5)
    rows = [("x", i, [f"c{k}" for k in range(100)] + [f"r{rng.randint(0, 400)}-{k}" for k in range(100)], str(i % 7)) for i in range(300)]
    named = Sm._named(spark.createDataFrame(rows, SCHEMA), ["card"], "id", "words", "nkey")
    assert Sm.candidate_pairs(named, ["card"], "words", 0.5, "nkey").count() < 300


def test_strip_reads_the_ends_only_and_takes_all_white_space(spark):
    codes = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c + "a " + c + " b" + c,) for c in codes] + [("",), ("  ",), (None,)], "t string")
    old = F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")
    assert df.where(~T.strip("t").eqNullSafe(old)).count() == 0
    assert "regexp" not in df.select(T.strip("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_metadata_is_looked_for_where_its_mark_is(spark):
    lines = ["- Note: .a  b;: [source: x.md; added: 2024-01-02]", "- Fact: c (since 2024-01-02; k:0123456789) ", "- [x] Note: d (since then) [y]", "- plain ..", None]
    r = spark.createDataFrame([(x,) for x in lines], "line string").select(Bu.claim("line").alias("c"), Bu.norm("line").alias("n"), Bu.meta("line").alias("m")).collect()
    assert [x.c for x in r] == [".a  b;:", "c", "d (since then) [y]", "plain ..", None]
    assert [x.n for x in r] == ["Note: a b", "Fact: c", "Note: d (since then) [y]", ": plain", None]
    assert [x.m and (x.m.source, x.m.added, x.m.form) for x in r] == [(["x.md"], "2024-01-02", "bracket"), (["k:0123456789"], "2024-01-02", "since"), None, None, None]
