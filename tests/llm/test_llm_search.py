"""Jaccard join, top-k search and URL rules against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import jaccard_join as jj
from tidewatch.llm import kd_search as kd
from tidewatch.llm import url_rules as ur

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block")]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for copies in (90, 30, 6):
        base = [rng.choice(words) for _ in range(rng.choice([60, 150, 300]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8])):
                i = rng.randrange(len(w))
                w[i] = rng.choice(words)
                if rng.random() < 0.3:
                    del w[i]
            texts.append(" ".join(w))
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([5, 20, 100]))) for _ in range(40)]
    texts += [" ".join(rng.choice(words[:30]) for _ in range(rng.randrange(12))) for _ in range(60)]
    texts += ["", None, " \t", "a", "A", "a b c", "A B C d", "a b c d", "é É", "x " * 500, "q" * 30_000, "r s t u " * 3000] * 2
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    rows += rows[:10]
    rng.shuffle(rows)
    return rows


def brute_components(rows, percent=85):
    classes = defaultdict(list)
    for doc_id, text in rows:
        classes[shingle_set(text)].append(doc_id)
    sets = [s for s in classes if s]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for k in range(i):
            n = len(s & sets[k])
            if n and 100 * n >= percent * (len(s) + len(sets[k]) - n):
                a, b = root(i), root(k)
                parent[max(a, b)] = min(a, b)
    smallest = {}
    for i, s in enumerate(sets):
        for doc_id in classes[s]:
            if doc_id is not None:
                smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    place = {s: smallest.get(root(i)) for i, s in enumerate(sets)}
    n_groups = len({root(i) for i in range(len(sets))}) + sum(not shingle_set(t) for _, t in rows)
    return Counter((d, len(shingle_set(t)), place[shingle_set(t)] if shingle_set(t) else d) for d, t in rows), n_groups


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 3000)])
def test_jaccard_join(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jj, "BLOCK_SHINGLES", block)  # small blocks: regions in several parts
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _key string, Best_ID int").repartition(5)
    want, groups = brute_components(rows)
    assert Counter(tuple(r) for r in jj.join(docs).collect()) == want
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == groups


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 3000)])
def test_link_counts(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jj, "BLOCK_SHINGLES", block)
    rows = corpus(seed)
    sets = [shingle_set(t) for _, t in rows]
    linked = lambda s, t: bool(s) and 100 * len(s & t) >= 85 * len(s | t)
    want = Counter((d, sum(linked(s, t) for t in sets) - bool(s)) for (d, _), s in zip(rows, sets))
    got = jj.link_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == want
    assert len({r.class_id for r in got} - {None}) == len(set(sets) - {frozenset()})


def clusters(seed, groups=6, copies=40):
    """Sets of near copies; some of neighbouring groups share half of their shingles."""
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(groups):
        base = rng.integers(0, 1 << 40, 120)
        if sets and rng.random() < 0.5:
            base[:60] = sets[-1][:60]
        for _ in range(copies):
            changed = base.copy()
            at = rng.integers(0, 120, rng.integers(0, 25))
            changed[at] = rng.integers(0, 1 << 40, len(at))
            sets.append(np.unique(changed))
    return sets


def links_of(sets):
    sets = [set(s.tolist()) for s in sets]
    return [(i, k) for i, s in enumerate(sets) for k in range(len(sets)) if i != k and 100 * len(s & sets[k]) >= 85 * len(s | sets[k])]


def test_voronoi_cells_of_a_task_hold_all_partners():
    sets = clusters(3)
    ids = np.arange(len(sets), dtype=np.int64) * 7919
    held = jj.Held.of(pd.DataFrame({"set": sets}))
    found = list(jj.cells_of(held, ids, np.ones(len(ids), bool), 85, lambda *_: None))
    assert len(found) > 3 and sum(len(h.rows) for h, _ in found) < 2 * len(sets)
    lives = {int(h.rows[i]): set(h.rows.tolist()) for h, home in found for i in np.flatnonzero(home)}
    assert sum(int(home.sum()) for _, home in found) == len(lives) == len(sets)
    assert all(k in lives[i] for i, k in links_of(sets))


def test_voronoi_cells_of_a_region_hold_all_partners(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK_SHINGLES", 6000)
    sets = clusters(4)
    rows = [("g", i, len(s)) for i, s in enumerate(sets)] + [("small", 1000, 3)]
    found = spark.createDataFrame(rows, "g string, cid long, n long")
    held = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "cid long, set array<long>")
    cells = jj._cells(found, lambda: held, 85).collect()
    members, lives = defaultdict(set), {}
    for r in cells:
        members[r.g].add(r.cid)
        if r.home:
            assert r.cid not in lives
            lives[r.cid] = r.g
    assert len(members) > 3 and members["small"] == {1000} and set(lives) == {r[1] for r in rows}
    assert len(cells) < 2 * len(rows) and len(cells) == sum(map(len, members.values()))
    assert all(k in members[lives[i]] for i, k in links_of(sets))


def test_jaccard_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jj.join(docs).count() == 0 and jj.keep_one(docs).count() == 0


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in jj.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_windows_hold_a_common_shingle():
    rng = np.random.default_rng(0)
    levels = np.zeros(jj.LEVELS, np.uint8)
    levels[rng.permutation(500)[:60]] = rng.integers(1, 255, 60)
    order = jj.Order(levels)
    for _ in range(300):
        x = np.unique(rng.integers(0, 500, rng.integers(1, 80)))
        y = np.unique(np.concatenate([rng.permutation(x)[: max(1, int(len(x) * 0.95))], rng.integers(0, 500, 2)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            a, b = (set(order.window(s, 85).tolist()) for s in (x, y))
            assert a & b


def brute_top(rows, k=5, every=50):
    vectors = {(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in vectors if i % every == 0}):
        scores = {(-sum(a * b for a, b in zip(v, w)), j) for i, v in vectors if i == q for j, w in vectors if j != q and len(w) == len(v)}
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("shard_rows,query_rows", [(10_000, 1000), (60, 3)])
def test_top_k(spark, shard_rows, query_rows):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 480)]  # ties
    rows += [(500, None), (501, []), (502, [float("nan")] * 6), (503, [None, 1.0]), (504, [float("inf")]), (None, [1.0] * 6)]
    rows += [(550, [1.0, 2.0]), (551, [2.0, 1.0]), (600, [1.0, 2.0, 3.0]), (7, rows[7][1]), (100, rows[100][1])]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<double>, id int, v string").repartition(4)
    got = kd.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, query_rows=query_rows)
    assert sorted(map(tuple, got.collect())) == brute_top(rows)
    assert kd.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_scores_past_doubles(spark):
    rows = [(0, [3.0e7, 1.0]), (1, [3.0e7, 2.0]), (2, [3.0e7, 1.0]), (3, [-3.0e7, 5.0])]
    got = kd.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert [(r.vec_id, r.score) for r in sorted(got.collect(), key=lambda r: r.rank)] == [
        (r[2], min(max(r[3], -(2**63) + 1), 2**63 - 1)) for r in brute_top(rows, every=100)
    ]


def brute_rule(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = lower(host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules(spark):
    urls = [
        None, "", "no url", "://", "http://", "http://A.Example.ORG/es/1?x", "https://example.org/en/14#x", "http://xexample.org/es/",
        "http://org", "http://org/", "ftp://a.b.com/de/x", "http://com/de/", "http://example.org?/es/", "http://é.org/ü/", "x://y://z.org/",
        "http://a.org./", "http://" + "a." * 2000 + "org/" + "p" * 5000, "HTTP://EXAMPLE.ORG/EN/1", "http://u@example.org:80/es/",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("a.org", "/", "block")], "host string, path string, verdict string")
    usable = [*RULES, ("a.org", "/", "block")]
    got = Counter(tuple(r) for r in ur.judge(pages.union(pages), rules).collect())
    assert got == Counter((i, *brute_rule(u, usable)) for i, u in enumerate(urls) for _ in range(2))
    assert {r.verdict for r in ur.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert ur.judge(pages.limit(0), rules).count() == 0


def test_shards_stream_over_small_batches(spark):
    """A shard's rows and queries may spread over many Arrow batches; every query still meets the whole shard."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {tuple(r) for r in kd.top_k(df, F.col("vec_id") % 5 == 0).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = {tuple(r) for r in kd.top_k(df, F.col("vec_id") % 5 == 0, shard_rows=50, query_rows=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts == whole and len(whole) == 300
