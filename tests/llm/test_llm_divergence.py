"""Source divergence against a plain loop."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm import source_divergence as sd


def plain(rows, at_least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups[lang].add(source)
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= at_least}
        whole = Counter()
        for s in sources:
            whole.update({t: n for t, n in counts[lang, s].items() if t in kept})

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            best = [(-f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            key = lambda x: (x[0], x[1].encode())
            for part, found in (("pair", sorted(pairs, key=key)), ("term", sorted(best, key=key)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    table = [(i, *r, 7, "clash") for i, r in enumerate(rows)]
    return spark.createDataFrame(table, "doc_id long, lang string, source string, text string, n int, term string").repartition(6)


@pytest.mark.parametrize("cells, at_least", [(sd.CELLS, 3), (40, 3), (40, 10)])
def test_same_as_plain_loop(spark, cells, at_least):
    rng = np.random.default_rng(5)
    words = ["Über", "straße", "été", "ALPHA", "beta", "Ägypten", "日本", "𝒳y", "a", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for i in range(160):
        lang = [None, "", "en", "fr", "solo"][i % 5]
        source = "hot" if rng.random() < 0.4 else f"s{i % 7}"
        source = "one" if lang == "solo" else source
        rows.append((lang, source, " ".join(rng.choice(words, rng.integers(0, 12)))))
    rows += [("en", "quiet", None), ("en", None, "12 34 -- [x]"), ("xx", "a", "rare"), ("xx", "b", ""), ("en", "hot", "beta " * 30_000)]
    rows += [("fr", "s1", "alpha,BETA\tgamma;alpha")] * 25
    out = sd.audit(frame(spark, rows), at_least, cells=cells)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == plain(rows, at_least)


def test_empty_table(spark):
    assert sd.audit(frame(spark, [])).count() == 0


def test_runs_are_few_where_counts_repeat_and_hold_all_rows():
    rng = np.random.default_rng(0)
    counts = rng.choice([0, 0, 0, 1, 2], (5_000, 4))
    ordered = sd.reordered(counts)
    assert sorted(map(tuple, ordered)) == sorted(map(tuple, counts))
    runs = [sd.run_lengths(ordered[:, i]) for i in range(4)]
    assert sum(len(s) for s, _ in runs) < 0.05 * counts.size
    for i, (starts, values) in enumerate(runs):
        assert (np.repeat(values, np.diff(starts, append=len(ordered))) == ordered[:, i]).all()


def test_shares_beyond_64_bits_are_exact():
    counts = np.array([0, 10**15], np.int64)
    assert sd.shares_of(counts, 10**16 + 7, 3).tolist() == [1 + 10**9 * (int(c) + 2) // (10**16 + 13) for c in counts]
