"""K-means through subvector dictionaries against a plain loop."""

import hashlib

import numpy as np
import pytest

from tidewatch.llm import subvector_means as sm

SCHEMA = "vec_id long, embedding array<double>, cluster string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA).repartition(5)


def plain(rows, clusters=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024 * float(x))) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        labels = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, labels) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    labels = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(d for d, _ in labels)
    return sorted(
        (str(i), c, d, sum(x for x, y in labels if y == c), total, digest[c]) for (i, _), (d, c) in zip(kept, labels)
    )


def got(df):
    return sorted((str(r.vec_id), *r[1:]) for r in df.collect())


def test_same_as_plain_loop_with_copies_ties_and_unfit_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.4, (60, 64)).round(2)
    rows = [(i, base[i % 60].tolist()) for i in range(90)]
    rows += [(i, base[0].tolist()) for i in range(200, 260)]  # a hot group of copies
    rows += [(5, base[7].tolist()), (5, base[7].tolist()), (None, base[8].tolist())]
    rows += [(300, None), (301, []), (302, [0.1] * 63), (303, [0.1] * 65), (304, [0.1] * 63 + [None])]
    rows += [(305, [float("nan")] + [0.0] * 63), (306, [float("-inf")] + [0.0] * 63), (307, [-0.0001] * 64)]
    assert got(sm.cluster(frame(spark, rows))) == plain(rows)


def test_fewer_vectors_than_clusters_and_large_components(spark):
    rows = [(1, [3e5] * 64), (2, [-4e6] * 64), (3, [5e6] * 63 + [0.0]), (4, [5e6] * 64)]
    assert got(sm.cluster(frame(spark, rows))) == plain(rows)
    rows = [(i, [4e12 * (1 - 2 * (i % 2))] * 64) for i in range(12)] + [(99, [1e30] * 64)]
    out = sm.cluster(frame(spark, rows), clusters=1).collect()
    assert len(out) == 12 and {r.distance for r in out} == {sm.LONG_MAX} and {r.inertia for r in out} == {sm.LONG_MAX}


def test_empty_table(spark):
    out = sm.cluster(frame(spark, []))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert out.count() == 0


@pytest.mark.parametrize("distinct, widths", [(3, {64, 32, 16}), (4000, {1})])
def test_encoding_is_lossless_and_wide_where_vectors_repeat(distinct, widths):
    rng = np.random.default_rng(0)
    vectors = rng.integers(-500, 500, (distinct, 64))[rng.integers(0, distinct, 4000)]
    width, entries, codes = sm.encode(vectors)
    assert width in widths
    assert (np.concatenate([e[codes[:, b]] for b, e in enumerate(entries)], axis=1) == vectors).all()
