"""Packing by the configuration linear program: exact on small cases, whole and dense on tables."""

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import lp_best_fit as bf
from tidewatch.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"


def fewest(pieces, room):
    """Least number of sequences by trying all fillings."""

    @cache
    def search(left):
        if not left:
            return 0
        first, rest = left[-1], left[:-1]  # the longest piece is in some sequence: choose its company
        fillings = {()}
        for i, p in enumerate(rest):
            fillings |= {(*f, i) for f in fillings if first + sum(rest[j] for j in f) + p <= room}
        return min(1 + search(tuple(p for i, p in enumerate(rest) if i not in f)) for f in fillings)

    return search(tuple(sorted(pieces)))


def held(plan):
    out = defaultdict(int)
    for contents, times in plan:
        for length, many in contents:
            out[length] += many * times
    return dict(out)


@pytest.mark.parametrize("seed", range(6))
def test_small_plans_are_near_the_optimum(seed):
    rng = np.random.default_rng(seed)
    pieces = rng.integers(1, 20, 11).tolist()
    histogram = {int(s): pieces.count(s) for s in set(pieces)}
    plan, bound = bf.packing_plan(histogram, 20)
    best = fewest(pieces, 20)
    assert held(plan) == histogram
    assert all(sum(s * n for s, n in contents) <= 20 for contents, _ in plan)
    assert bound <= best + 1e-6
    assert sum(times for _, times in plan) <= best + 1


def test_large_histogram_is_packed_close_to_its_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, rng.lognormal(6.3, 0.9, 60_000).astype(int) + 1)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(lengths, return_counts=True))}
    plan, bound = bf.packing_plan(histogram)
    used = sum(times for _, times in plan)
    assert held(plan) == histogram
    assert all(sum(s * n for s, n in contents) <= 2048 for contents, _ in plan)
    assert bound <= used <= 1.001 * max(bound, lengths.sum() / 2048) + 1


def test_most_pieces_come_from_rounded_configurations():
    rng = np.random.default_rng(1)
    lengths = rng.integers(40, 1400, 50_000)
    size, demand = np.unique(lengths, return_counts=True)
    left = dict(zip(size.tolist(), demand.tolist()))
    plan = bf.rounded(bf.configurations(size, demand, 2048)[0], left)
    assert sum(s * n for s, n in held(plan).items()) > 0.75 * lengths.sum()
    assert all(n >= 0 for n in left.values())


def check_sequences(rows, room):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for some in by.values():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == np.cumsum([0, *(r.length for r in some)])[:-1].tolist()
        assert sum(r.length for r in some) <= room
    return by


def test_pieces_are_those_of_the_library_on_odd_rows(spark):
    texts = ["", None, "a", "two words", "word " * 5000, "ünïcode ☃ text", "word " * 2047, "word " * 2048, "x" * 9000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] * 2 + [(None, "no id", "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length int").repartition(4)
    out = bf.pack(docs, tokenizer("word_bpe_49k.json")).collect()
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = []
    for i, t, *_ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            want.append((i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[:5]) for r in out), key=key) == sorted(want, key=key)
    assert len(check_sequences(out, 2048)) <= 1 + -(-sum(r.length for r in out) // 2048)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bf.pack(docs, tokenizer("word_bpe_49k.json")).count() == 0


def test_query_packs_whole_documents_densely(spark):
    rows = QUERIES["op12_lp_best_fit"](spark, SF).collect()
    check_sequences(rows, 2048)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for some in by_doc.values():
        some.sort(key=lambda r: r.piece)
        assert [r.start for r in some] == [2048 * r.piece for r in some]
        assert all(r.length == 2048 for r in some[:-1])
    used = len({r.sequence_id for r in rows})
    assert used <= 2 + 1.01 * sum(r.length for r in rows) / 2048
