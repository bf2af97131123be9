"""Near-duplicates, line deduplication, decontamination, mixing, url filter and the pipeline against brute force."""

import math
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from helpers import Groups, documents, prose, shingle_set, words

from dossier.llm import decontaminate, link, linededup, mixing, neardup, urls


def brute_components(texts, k):
    sets = [shingle_set(t, k) for t in texts]
    g = Groups()
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                g.join(a, b)
    return {i: (len(sets[i]), g.root(i)) for i in range(len(texts))}


def copies(rng, n, edits):
    """Texts derived from a few originals by changing words, and from each other."""
    texts = [prose(rng, rng.choice([3, 8, 40, 120])) for _ in range(n // 6)]
    while len(texts) < n:
        w = rng.choice(texts).split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(11)
    for k, edits in ((2, 6), (5, 2)):
        texts = copies(rng, 260, edits) + [None, "", " \n\t", "one", "ONE", "one two", "One  two"]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, texts), words=k).collect()}
        assert got == brute_components(texts, k)


def test_chain_of_copies_is_one_group(spark):
    """Each text is similar to its neighbours only; no text is similar to all."""
    w = [f"w{i}" for i in range(400)]
    texts = [" ".join(w[10 * i:10 * i + 120]) for i in range(20)]
    rows = neardup.near_duplicates(documents(spark, texts), words=2).collect()
    assert {r.component_id for r in rows} == {0} and sum(r.kept for r in rows) == 1


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 3000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.concatenate([a[: len(a) * 4 // 5], rng.integers(0, 1 << 62, len(a) - len(a) * 4 // 5).astype(np.uint64)])
        s = neardup.sketches([a, np.unique(b)], 512)
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        if n == 3000:
            assert abs((s[0] == s[1]).mean() - 0.8 / 1.2) < 0.08


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as rep", "1 as n_shingles", "'y' as id", "2 as comp", "3 as key")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (3, 0, 3, True), (4, 0, 4, True)], key=str)
    assert sorted(str(r.doc_id) for r in neardup.survivors(df).collect()) == ["1", "1", "3", "4", "None"]
    lines = {(r.row.doc_id, r.kept_text) for r in linededup.dedup_lines(df).collect()}
    assert lines == {(1, "a b c d e f"), (2, ""), (None, "a b c d e f"), (3, None), (4, "")}


def test_groups_of_links(spark):
    rng = random.Random(12)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    g = Groups()
    for a, b in pairs:
        if a != b:
            g.join(a, b)
    got = {r.id: r.comp for r in link.groups(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: g.root(x) for x in g.up}


def brute_lines(texts):
    """Equal normalised lines, and those within edit similarity 0.9 whose fingerprints share two blocks, by Levenshtein."""
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        for j, x in enumerate((t or "").split("\n")):
            w = "".join(c.lower() if c.isalnum() else " " for c in x).split()
            if w:
                seen[" ".join(w)].append((i, j))
    return seen


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup_keeps_first_of_each_group(spark):
    rng = random.Random(13)
    lines = [prose(rng, rng.randint(6, 40)) for _ in range(40)]
    texts = []
    for _ in range(120):
        own = [rng.choice(lines) if rng.random() < 0.5 else prose(rng, 12) for _ in range(rng.randint(1, 5))]
        texts.append("\n".join(x.upper() + "!" if rng.random() < 0.3 else x for x in own))
    texts += [None, "", "\n\n", "...\n...", "the same line over and over\n\nThe SAME line, over and over."]
    rows = {r.row.doc_id: r for r in linededup.dedup_lines(documents(spark, texts)).collect()}
    keep = {places[0] for places in brute_lines(texts).values()}
    distinct = list(brute_lines(texts))
    assert not any(levenshtein(a, b) <= 0.1 * max(len(a), len(b)) for i, a in enumerate(distinct[:150]) for b in distinct[:i])    # no fuzzy pairs here
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i].kept_text is None and rows[i].n_removed == 0
            continue
        split = t.split("\n")
        want = [x for j, x in enumerate(split) if (i, j) in keep or not "".join(c for c in x if c.isalnum())]
        assert rows[i].kept_text == "\n".join(want) and rows[i].n_removed == len(split) - len(want)


def test_line_dedup_joins_fuzzy_lines_and_leaves_different_ones(spark):
    rng = random.Random(14)
    base = [prose(rng, 150) for _ in range(30)]
    near = [x.replace(x.split()[50], "changed", 1) for x in base]
    texts = base + near + [prose(rng, 150) for _ in range(30)]
    rows = {r.row.doc_id: r.n_removed for r in linededup.dedup_lines(documents(spark, texts)).collect()}
    assert all(rows[i] == 0 for i in [*range(30), *range(60, 90)])
    assert sum(rows[i] for i in range(30, 60)) >= 15        # one word in 150 usually leaves two of four blocks alone


def brute_matches(texts, items):
    norm = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
    def sh(w):
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    its = {i: norm(t) for i, t in items if norm(t)}
    df = Counter(s for w in its.values() for s in sh(w))
    weight = lambda s: math.log(1 + len(its) / max(df[s], 1))
    out = {}
    for d, t in enumerate(texts):
        w = norm(t)
        for i, iw in its.items():
            best = 0
            for start in range(max(1, len(w))):
                x = sh(w[start:start + len(iw)]) if w else set()
                both = sum(map(weight, x & sh(iw)))
                best = max(best, both / sum(map(weight, x | sh(iw))) if x else 0)
            if best >= 0.8:
                out[(d, i)] = round(best, 9)
    return out


def test_decontamination_against_all_windows(spark):
    rng = random.Random(15)
    items = [(i, prose(rng, rng.choice([14, 20, 36, 59]), 2000)) for i in range(12)] + [(12, "only three words"), (13, None), (14, "")]
    items.append((15, items[0][1] + " and more words at the end of it"))
    texts = []
    for i in range(60):
        body = prose(rng, 80, 2000).split()
        kind = i % 4
        if kind == 1:
            body[30:30] = items[i % 12][1].upper().replace(" ", ",\n").split(" ")
        if kind == 2:
            cut = items[i % 12][1].split()
            body[10:10] = cut[1:]
        if kind == 3 and i % 8 == 3:
            body = items[i % 12][1].split()
        texts.append(" ".join(body))
    texts += [None, "", "Only three words", "so only three words here"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(documents(spark, texts), bench).collect()}
    want = brute_matches(texts, items)
    verbatim = {k for k, v in want.items() if v == 1}
    assert verbatim and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    left = {r.doc_id for r in decontaminate.clean(documents(spark, texts), bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(documents(spark, texts), empty).count() == 0


def test_decontamination_misses_no_near_copy_of_a_short_item(spark):
    """Two to four words changed at the ends or anywhere, a word put in or left out, and two texts of one id: the pairs of brute force."""
    rng = random.Random(23)
    items = [(i, prose(rng, 16 + i % 10, 2000)) for i in range(20)]
    texts = []
    for i in range(200):
        w, kind = items[i % 20][1].split(), i // 20
        if kind < 3:
            w[-2 - kind:] = [f"x{j}" for j in range(2 + kind)]
        elif kind < 5:
            w[:kind - 1] = [f"x{j}" for j in range(kind - 1)]
        elif kind == 5:
            w[0], w[-1] = "x0", "x1"
        elif kind == 6:
            w[:2], w[-2:] = ["x0", "x1"], ["x2", "x3"]
        elif kind == 7:
            w.insert(len(w) // 2, "x0")
        elif kind == 8:
            del w[rng.choice([0, 1, -2, -1])]
        else:
            w[rng.randrange(len(w))] = "x0"
        texts.append(" ".join([prose(rng, rng.randrange(30), 2000), *w, prose(rng, rng.randrange(30), 2000)]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(documents(spark, texts), bench).collect()}
    want = brute_matches(texts, items)
    assert len(want) > 40 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    halves = items[0][1].split()
    split = [(1, " ".join(halves[:9])), (1, " ".join(["x"] * 9 + halves[9:])), (2, items[0][1]), (2, "else")]
    found = decontaminate.matches(spark.createDataFrame(split, "doc_id long, text string"), bench).collect()
    assert [(r.doc_id, r.item_id, r.similarity) for r in found] == [(2, 0, 1.0)]


def test_decontamination_by_items_that_share_an_id_and_windows_alike_by_weight(spark):
    rng = random.Random(30)
    one, two = prose(rng, 20, 2000), prose(rng, 25, 2000)
    frame = prose(rng, 30, 2000)                        # words of most items: they weigh little
    framed = [(i, frame + " " + prose(rng, 40, 2000)) for i in range(10, 40)]
    items = [(1, one), (1, two), *framed]
    texts = [f"a {two} b", f"a {one} b", prose(rng, 60, 2000)] + [prose(rng, 26, 3000) + " " + " ".join(x.split()[26:]) for _, x in framed[:5]]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.pop((0, 1)) == 1 and got.pop((1, 1)) == 1
    numbered = list(enumerate(x for _, x in items))
    want = {(d, items[i][0]): v for (d, i), v in brute_matches(texts, numbered).items() if i > 1}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = random.Random(31)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(64) for _ in range(5)]
    rows = []
    for k in range(400):
        item, x = k % 5, base[k % 5]
        for bit in rng.sample(range(64), rng.randint(0, 30)):
            x ^= 1 << bit
        rows.append((k, item, signed(x)))
    got = decontaminate.within_radius(spark.createDataFrame(rows, "k long, item long, fp long"), spark.createDataFrame([(i, signed(x)) for i, x in enumerate(base)], "item long, fp long"))
    near = sorted(k for k, i, x in rows if bin((x ^ base[i]) & (2**64 - 1)).count("1") <= decontaminate.RADIUS)
    assert sorted(r.k for r in got.collect()) == near and 100 < len(near) < 400


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if t[s] > 2 * sizes[s]]
        if not above:
            return {**fixed, **t}
        fixed.update({s: 2.0 * sizes[s] for s in above})


def test_mixing_meets_targets(spark):
    rng = random.Random(16)
    sources = [rng.choice(["a", "b", "c", "d", "é", None, "hot", "hot", "hot"]) for _ in range(900)] + ["empty"]
    texts = [prose(rng, min(3000, int(rng.paretovariate(1.1) * 20))) for _ in range(900)] + [None]
    first = mixing.mix(documents(spark, texts, sources)).collect()
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    taken = Counter()
    for r in first:
        assert r.size == len(words(texts[r.doc_id])) and r.source_size == sizes[sources[r.doc_id]]
        assert abs(r.target - want[sources[r.doc_id]]) <= 1e-6 * max(1, r.target)
        assert r.taken == r.copies * r.size and r.copies in (0, 1, 2)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.01 * t + 30, s
    again = mixing.mix(documents(spark, texts, sources).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)


def test_rates_solve_the_dual(spark):
    """Rates are 2 / (1 + exp(-m * size / mean)) with one m per source."""
    rng = random.Random(17)
    rows = mixing.mix(documents(spark, [prose(rng, rng.randint(1, 200)) for _ in range(400)], [f"s{i % 4}" for i in range(400)])).collect()
    by = defaultdict(list)
    for r in rows:
        if 0 < r.rate < 2 and r.size:
            by[r.source].append(-math.log(2 / r.rate - 1) / r.size)
    assert by and all(max(x) - min(x) < 1e-6 for x in by.values())


def test_mixing_of_nothing(spark):
    assert mixing.mix(documents(spark, [])).count() == 0


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [h + p for h, p, _ in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_urls_rules_and_paths(spark):
    rng = random.Random(18)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.net", "net", "com", "x.org", "notexample.com", "b.a.net", ""]
    tails = ["", "/", "/en/", "/en", "/en/1?x=/es/", "/es/2#t", "/fr/", "?q=/en/", "#/en/", "/a\n/es/"]
    seen = [rng.choice(["http", "https", ""]) + rng.choice(["://", "://", ":/"]) + rng.choice(hosts) + rng.choice(tails) for _ in range(600)] + [None, "", "nothing"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(seen)], "page_id long, url string, html string")
    says = {h + p: v for h, p, v in urls.RULES}
    rows = urls.verdicts(pages).collect()
    assert len(rows) == len(seen)
    for r in rows:
        assert (r.host, r.path, r.rule) == brute_rule(seen[r.page_id]), seen[r.page_id]
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == says[r.rule])


def test_urls_trust_and_distrust_spread(spark):
    """Hosts that link to blocked hosts are blocked; hosts that trusted ones link to are not."""
    to = lambda *hs: "".join(f'<a href="https://{h}/x">' for h in hs)
    rows = [(0, "http://good.com/a", to("fine.org")), (1, "http://fine.org/", to("leaf.org")), (2, "http://leaf.org/", None),
            (3, "http://bad.net/es/", ""), (4, "http://feeder.org/", to("bad.net", "bad.net")), (5, "http://second.org/", to("feeder.org")),
            (6, "http://alone.org/", '<a href="/x">')]
    got = {r.page_id: r.verdict for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "allow", 1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow"}


def test_urls_distrust_reaches_hosts_of_one_domain_without_pages_of_its_own(spark):
    rows = [(0, "http://a.bad.net/es/1", None), (1, "http://b.bad.net/x", None), (2, "http://c.d.bad.net/x", None), (3, "http://a.good.com/", None),
            (4, "http://b.other.org/x", None), (5, "http://10.0.0.1/x", None), (6, "http://10.0.0.2/x", None)]
    got = {r.page_id: r.verdict for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}
    names = spark.createDataFrame([("a.b.c.d",), ("x.c.d",), ("c.d",), ("d",), ("10.0.0.1",), ("10.0.0.1:80",)], "host string")
    assert sorted((r.src, r.dst) for r in urls.parents(names).collect()) == [("a.b.c.d", "b.c.d"), ("b.c.d", "c.d"), ("x.c.d", "c.d")]


def fixed_point(pairs, weight, start, damping):
    """Personalised PageRank by solving its linear equations."""
    n = len(start)
    m = np.zeros((n, n))
    for a, b in pairs:
        m[b, a] = weight[a, b] / sum(weight[a, c] for x, c in pairs if x == a)
    return np.linalg.solve(np.eye(n) - damping * m, (1 - damping) * start)


def test_spread_is_personalised_pagerank(spark):
    rng = random.Random(19)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(40)) if a != b})
    out = Counter(a for a, _ in pairs)
    edges = spark.createDataFrame([(w, str(a), str(b), 1 / out[a]) for a, b in pairs for w in "xy"], "way string, src string, dst string, share double")
    seeds = spark.createDataFrame([("x", "0", 0.75), ("x", "5", 0.25), ("y", "3", 1.0)], "way string, host string, seed double")
    got = {(r.way, r.host): r["rank"] for r in urls._spread(edges, seeds).collect()}
    for way, at in (("x", {0: 0.75, 5: 0.25}), ("y", {3: 1.0})):
        start = np.array([at.get(i, 0.0) for i in range(12)])
        x = fixed_point(pairs, {p: 1.0 for p in pairs}, start, urls.DAMPING)
        assert all(abs(got.get((way, str(i)), 0) - x[i]) < 1e-5 for i in range(12))
    assert urls._spread(edges, seeds.limit(0)).count() == 0


def test_distrust_crosses_any_distance(spark):
    """Each host links to the one before; the first is blocked."""
    rows = [(0, "http://h0.net/es/", None)] + [(i, f"http://h{i}.org/", f'<a href="http://h{i - 1}.{"net" if i == 1 else "org"}/">') for i in range(1, 30)]
    got = urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 30 and {r.verdict for r in got} == {"block"}


def test_verdicts_of_a_web_of_hosts_against_the_dense_fixed_point(spark):
    rng = random.Random(27)
    names = [f"h{i}.{'net' if i % 5 == 0 else 'com' if i % 5 == 1 else 'org'}" for i in range(60)]
    rows, links = [], Counter()
    for p in range(500):
        i = p % 60
        to = [j for j in (rng.randrange(60) for _ in range(rng.randint(0, 2))) if j != i]
        links.update((i, j) for j in to)
        rows.append((p, f"http://{names[i]}/{'es' if i % 5 == 0 else 'x'}/{p}", "".join(f'<a href="http://{names[j]}/">' for j in to)))
    got = {r.host: r.verdict for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).where("rule is null").collect()}
    pages = Counter(p % 60 for p in range(500))
    def ranks(kind, edges):
        start = np.array([pages[i] if i % 5 == kind else 0 for i in range(60)], dtype=float)
        return fixed_point(sorted(edges), edges, start / start.sum(), urls.DAMPING)
    trust, distrust = ranks(1, links), ranks(0, Counter({(b, a): n for (a, b), n in links.items()}))
    want = {names[i]: "block" if distrust[i] > trust[i] else "allow" for i in range(60) if i % 5 > 1}
    assert got == want and len(set(want.values())) == 2


def test_long_lines_have_the_fingerprint_of_short_ones(spark, monkeypatch):
    rng = random.Random(28)
    df = documents(spark, ["\n".join(prose(rng, n, 50) for n in (3, 12, 13, 200)), "x " * 40, None, ""])
    want = sorted(linededup.occurrences(df, "doc_id", "text").drop("row").collect())
    monkeypatch.setattr(linededup, "PIECE", 12)
    assert sorted(linededup.occurrences(df, "doc_id", "text").drop("row").collect()) == want and len(want) == 5


def test_only_lines_that_meet_others_go_to_the_buckets(spark, monkeypatch):
    """Names of eight bytes, and of the six rows a line has only those whose key another line has too."""
    rng, seen = random.Random(30), []
    base = [prose(rng, 150) for _ in range(60)]
    near = [x.replace(x.split()[50], "changed", 1) for x in base[:5]]
    plain = linededup.link

    def spied(buckets, *rest):
        seen.append((buckets.groupBy("key").count().where("count < 2").count(), dict(buckets.dtypes)["id"]))
        return plain(buckets, *rest)

    monkeypatch.setattr(linededup, "link", spied)
    rows = {r.row.doc_id: r.n_removed for r in linededup.dedup_lines(documents(spark, near + base)).collect()}
    assert seen == [(0, "bigint")]
    assert all(rows[i] == 0 for i in [*range(5), *range(10, 65)]) and sum(rows.values()) >= 2


def test_unrelated_lines_with_a_frequent_word_never_become_candidates(spark, monkeypatch):
    """A frequent word brings fingerprints close; the pairs of neighbouring words tell such lines apart before their texts travel."""
    rng, seen = random.Random(31), []
    apart = [" ".join(f"the r{rng.randrange(10 ** 7)}" for _ in range(60)) for _ in range(60)]
    base = [prose(rng, 150, 4000) for _ in range(20)]
    near = [x.replace(x.split()[50], "changed", 1) for x in base]
    plain = linededup.link

    def spied(buckets, verify, fits):
        def counted(candidates):
            seen.append(candidates.count())
            return verify(candidates)
        return plain(buckets, counted, fits)

    monkeypatch.setattr(linededup, "link", spied)
    rows = {r.row.doc_id: r.n_removed for r in linededup.dedup_lines(documents(spark, apart + base + near)).collect()}
    assert sum(seen) <= 150         # 20 pairs of near lines and a hundredth of the others, by chance
    assert all(rows[i] == 0 for i in range(80)) and sum(rows[i] for i in range(80, 100)) >= 8


def test_line_dedup_of_very_long_lines(spark):
    """More words than a 16-bit counter holds: equal up to case, one word apart, and different."""
    rng = random.Random(29)
    line = prose(rng, 20_000)
    other = " ".join(f"x{rng.randrange(400)}" for _ in range(20_000))
    texts = [line, line.upper(), line.replace(" w7 ", " changed ", 1), other]
    assert [r.n_removed for r in sorted(linededup.dedup_lines(documents(spark, texts)).collect(), key=lambda r: r.row.doc_id)] == [0, 1, 1, 0]


def test_texts_that_share_an_id_lose_only_what_is_repeated(spark):
    rows = [(1, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "totally different unique words here"), (6, "totally different unique words here\nalso own words"),
            (7, "equal rows stay"), (7, "equal rows stay")]
    got = sorted((r.row.doc_id, r.kept_text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "alpha beta gamma delta"), (5, ""), (5, "totally different unique words here"), (6, "also own words"), (7, "equal rows stay"), (7, "equal rows stay")]


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from dossier.llm.common import scratch, stored
    paths = lambda df: [f[len("file://"):].rsplit("/", 1)[0] for f in df.inputFiles()]
    with scratch(spark) as keep:
        a = stored(spark.range(3), "a")
        with scratch(spark) as inner:
            b = stored(a, "b")
            c = inner(b, "c")
            at_b = paths(b)
        at_a, at_c = paths(a), paths(c)
        assert not any(map(os.path.exists, at_b)) and all(map(os.path.exists, at_c))
        d = keep(c, "d")
    assert not any(map(os.path.exists, at_a + at_c)) and d.count() == 3
