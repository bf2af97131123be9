"""Secret, personal-data, licence and token scans against the plain expressions and the tokenizer library."""

import hashlib
import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import documents, lower, words

from dossier.llm import licenses, pii, quality, secrets, tokens
from dossier.llm.license_texts import MIT, TEMPLATES


def digest(found):
    return hashlib.sha256(",".join(":".join(map(str, x)) for x in found).encode()).hexdigest()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def brute_secrets(t):
    t = t or ""
    kinds = [[("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6],
             [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20],
             [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]]
    order = ["assign", "access", "hex"]
    return [len(k) for k in kinds], sorted((x for k in kinds for x in k), key=lambda x: (x[1], order.index(x[0])))


SECRET_PARTS = ["password", "passwd", "Token", "apikey", "API_KEY", "secret", "=", ":", " ", "  ", '"', "'", "abc", "abcdef12", "AKIA", "AKIAB",
                "0123456789ABCDEF", "deadbeef", "0123456789abcdef", ".", "-", "\n", "key", "é", "😀", "xoxb-"]


def test_secrets_against_expressions(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(SECRET_PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [None, "", "token=" + "a" * 200_000, "password" * 5000, "x" * 100_000 + " secret: abcdef"]
    for r in secrets.scan(documents(spark, texts), ["doc_id"]).collect():
        counts, spans = brute_secrets(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts, texts[r.doc_id]
        assert r.base_sha256 == digest(spans)
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(","))  or not spans


def test_secrets_added_rules(spark):
    text = "é ghp_" + "a1B2" * 10 + " then -----BEGIN RSA PRIVATE KEY----- end"
    row = secrets.scan(documents(spark, [text]), ["doc_id"]).first()
    assert row.spans == "github:2:46,pem:52:83" and row.n_assign == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_pii(t):
    t = t or ""
    digits = lambda x: re.sub("[^0-9]", "", x)
    found = [[("email", m.start(), m.end()) for m in EMAIL.finditer(t)],
             [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
             [("card", m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
             [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]]
    return [len(x) for x in found], digest([x for k in found for x in k])


def test_pii_against_expressions(spark):
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "x@y.z", ".", "..", "_", "%", "+", "1", "12", "255", "256", "0", "1.2.3.4", "4111 1111 1111 1111", "4532015112830366",
             "-", " ", "(", ")", "+1 (988) 555-2485", "é", "😀", "\n", "@d.e-f", "00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "1" * 30_000 + " " + "a.b-" * 20_000 + "@x" + ".y" * 20_000]
    rows = pii.scan(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == brute_pii(texts[r.doc_id]), texts[r.doc_id]


def test_pii_contexts_discover_what_no_expression_describes(spark):
    texts = [f"contact u{i}@ex.com now" for i in range(40)] + ["contact joe_2(at)ex.com now", "page 1234567 of", "the 7654321"]
    rows = {r.doc_id: r.spans for r in pii.scan(documents(spark, texts)).collect()}
    assert rows[40] == "email:8:23" and rows[41] == "" and rows[42] == "" and rows[0] == "email:8:17"


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licenses_base_and_templates(spark):
    rng = random.Random(2)
    parts = ["MIT", "license", "License,", "apache", "general", "public", "GNU", "x", "é", "-", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(800)] + [None, "", f"Preface. {MIT} After", " ".join(MIT.split()[:20])]
    for r in licenses.scan(documents(spark, texts), ["doc_id"]).collect():
        w = LICENSE_WORD.findall(lower(texts[r.doc_id]))
        places, labels = [], set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | (set() if labels else {""})
        assert 0 <= r.score <= 1
        if r.doc_id == len(texts) - 2:
            assert r.labels == "mit" and r.score == 1
        if r.doc_id == len(texts) - 1:
            assert r.labels == "" and 0 < r.score < licenses.COVERED


def test_suffix_automaton_against_all_runs():
    rng = random.Random(3)
    for _ in range(300):
        bodies = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        machine = licenses.SuffixAutomaton(bodies)
        runs = {}
        for t, x in enumerate(bodies):
            for i in range(len(x)):
                for j in range(i + 1, len(x) + 1):
                    runs.setdefault(tuple(x[i:j]), {}).setdefault(t, set()).add(j - 1)
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(25)]
        best = [max(n for n in range(i + 2) if n == 0 or tuple(text[i - n + 1:i + 1]) in runs) for i in range(len(text))]
        want = [(i, n) for i, n in enumerate(best) if n >= licenses.LEAST_RUN and (i + 1 == len(text) or best[i + 1] != n + 1)]
        got = machine.runs(text)
        assert [(i, n) for i, n, _ in got] == want
        for i, n, state in got:
            held = runs[tuple(text[i - n + 1:i + 1])]
            assert machine.ends[state] == held
    assert len({n for n, _ in TEMPLATES}) == len(TEMPLATES)


def test_tokens_equal_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(4)
    parts = ["'s", "<|startoftext|>", "<|endoftext|>", "Σ", "İ", "a", "aaa", "é", "é", " ", "\n", "\x1c", " ", "12", "!!", "中文", "😀", "ing", "the", "<|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + [None, "", "a" * 20_000, "ab" * 3000]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        lib = Tokenizer.from_file(public.path(name))
        want = [len(e.ids) for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        for r in tokens.over(tokens.count(documents(spark, texts), ["doc_id"], public.path(name)), 2048).collect():
            t = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), want[r.doc_id], want[r.doc_id] > 2048), (name, t[:80])


def test_splitting_agrees_with_the_library_on_the_basic_plane():
    public = pytest.importorskip("public_tokenizers")
    import json

    spec = json.loads(Path(public.path("word_bpe_49k.json")).read_text(encoding="utf-8"))
    split = tokens.Splitter(json.dumps(spec | {"added_tokens": [], "model": {**spec["model"], "vocab": {}, "merges": []}}))
    assert split.find
    for c in range(1, 0x10000):
        if not 0xD800 <= c < 0xE000:
            x = f"a{chr(c)}1{chr(c)}!"
            assert len(split.find(x)) == len(split.split.pre_tokenize_str(x)), hex(c)


def brute_quality(t):
    w = words(t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_against_brute_force(spark):
    rng = random.Random(6)
    parts = ["a", "b", "cé", "#", "x|y", "😀", "\x1c", " "]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", "\t", "\x0b", ""]) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, ""]
    rows = quality.judge(documents(spark, texts), ["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_quality(texts[r.doc_id])
        assert tuple(r[m] for m in quality.MEASURES) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (r.kept and failed)


def test_quality_keeps_prose_and_rejects_symbols(spark):
    rng = random.Random(7)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(120)) + "." for _ in range(60)]
    bad = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) + rng.choice(["$$$", "***", "&&&"]) for _ in range(120)) for _ in range(12)]
    kept = {r.doc_id for r in quality.judge(documents(spark, good + bad), ["doc_id"]).where("kept").collect()}
    assert kept == set(range(60))
    assert {r.doc_id for r in quality.accept(documents(spark, good + bad)).collect()} == kept


def test_pii_context_words_may_stand_far_away(spark):
    gap = "-" * 60
    texts = [f"contact {gap} u{i}@ex.com" for i in range(40)] + [f"contact {gap} joe_2(at)ex.com"]
    rows = {r.doc_id: r.spans for r in pii.scan(documents(spark, texts)).collect()}
    assert rows[40] == "email:69:84"


def test_pii_discovery_goes_on_until_nothing_changes(spark):
    """Every context is confident only once what was found in the one before is counted in it."""
    texts = [f"ctxa a{i}@ex.com" for i in range(40)] + [f"ctxa hidden{j}zero(at)x" for j in range(6)]
    hidden = list(range(40, 46))
    for k in range(1, 6):
        name = "ctx" + "abcdefg"[k]
        texts += [f"{name} seed{k}x{i}@ex.com" for i in range(24)] + [t.replace("ctx" + "abcdefg"[k - 1], name) for t in (texts[h] for h in hidden[-6:-2])]
        hidden += range(len(texts), len(texts) + 6)
        texts += [f"{name} hidden{k}{j}more(at)x" for j in range(6)]
    rows = {r.doc_id: r.spans for r in pii.scan(documents(spark, texts)).collect()}
    assert all(rows[i] == f"email:5:{len(texts[i])}" for i in hidden)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.scan(none).count() == 0


def test_licenses_that_contain_another_and_runs_that_stand_twice(spark):
    body = dict(TEMPLATES)
    two, three = body["bsd-2-clause"], body["bsd-3-clause"]
    changed = two
    for w in ("modification", "conditions are", "retain", "binary form must", "materials"):
        assert w in changed
        changed = changed.replace(w, "zzz", 1)
    texts = [two, three, two + " x" * 50 + " " + MIT, changed, "intro " + three.replace("specific", "zzz")]
    rows = {r.doc_id: r for r in licenses.scan(documents(spark, texts), ["doc_id"]).collect()}
    assert [rows[i].labels for i in range(5)] == ["bsd-2-clause", "bsd-3-clause", "bsd-2-clause,mit", "bsd-2-clause", "bsd-3-clause"]
    machine = licenses.SuffixAutomaton([b"a b c d e f x a b c d e g".split()])
    (end,) = [s for _, _, s in machine.runs(b"a b c d e".split())]
    assert machine.ends[end] == {0: {4, 11}}
