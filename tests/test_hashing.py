import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import hashing, neighbours

WIDTH = 64


@pytest.fixture(scope="module")
def vectors(spark):
    """6,000 vectors of 64 components around 60 centres, some of them repeated."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, WIDTH))
    x = centres[rng.integers(0, 60, 6_000)] + 0.35 * rng.normal(size=(6_000, WIDTH))
    x[5_900:] = x[0]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k bigint, v array<double>"), x


def brute_force(x, row, k):
    d2 = ((x - x[row]) ** 2).sum(axis=1)
    order = sorted((d, i) for i, d in enumerate(d2.tolist()) if i != row)
    return [i for _, i in order[:k]], [d**0.5 for d, _ in order[:k]]


def test_recall_in_64_dimensions(vectors):
    df, x = vectors
    found = hashing.hashed_neighbours(df, "k", F.col("v"), 5, bucket_points=400).where("k % 20 = 0").collect()
    hits = 0
    for row in found:
        want, distances = brute_force(x, row.k, 5)
        assert len(row.neighbours) == 5
        # What is found has its exact distance, and equal distances count alike.
        for n in row.neighbours:
            assert n.distance == pytest.approx(float(np.linalg.norm(x[n.id] - x[row.k])), abs=1e-9)
            hits += n.distance <= distances[-1] + 1e-9
    assert len(found) == 300 and hits / 1_500 >= 0.9


def test_one_bucket_is_exact(spark):
    rows = spark.range(0, 400).select(
        F.col("id").alias("k"), *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(50)).cast("double").alias(f"c{i}") for i in range(3)]
    )
    exact = neighbours.nearest_neighbours(rows, "k", ["c0", "c1", "c2"], 4).collect()
    hashed = hashing.hashed_neighbours(rows, "k", F.array("c0", "c1", "c2"), 4).collect()
    assert {r.k: [n.id for n in r.neighbours] for r in exact} == {r.k: [n.id for n in r.neighbours] for r in hashed}


def test_hot_buckets_are_searched_in_blocks(vectors, monkeypatch):
    """With fewer cuts than the points need, blocks keep the result of one whole bucket."""
    df, x = vectors
    monkeypatch.setattr(hashing, "MAX_DEPTH", 0)
    found = hashing.hashed_neighbours(df.where("k < 500"), "k", F.col("v"), 3, bucket_points=100).collect()
    assert all([n.id for n in r.neighbours] == brute_force(x[:500], r.k, 3)[0] for r in found)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, None), (6, []), (7, [inf, 1.0]),
            (8, [1.0]), (None, [0.0, 0.0]), (9, [None, 1.0])]
    df = spark.createDataFrame(rows, "k bigint, v array<double>").withColumn("ids", F.lit("x"))
    found = {r.k: [(n.id, n.distance) for n in r.neighbours] for r in hashing.hashed_neighbours(df, "k", F.col("v"), 2).collect()}
    assert found == {1: [(3, 0.0), (2, 1.0)], 3: [(1, 0.0), (2, 1.0)], 2: [(1, 1.0), (3, 1.0)]}
    assert hashing.hashed_neighbours(df.where("k > 99"), "k", F.col("v")).count() == 0


def test_probes_hold_the_own_bucket():
    x = np.random.default_rng(3).normal(size=(2_000, 8))
    one = hashing.Table(0, 1, 8, x, 5)
    rows, buckets = one.probes(x, 3)
    own = one.cells.locate(x @ one.directions)
    assert len(rows) == 6_000 and (buckets.reshape(-1, 3)[:, 0] == own).all()
    assert all(len(set(b)) == 3 for b in buckets.reshape(-1, 3).tolist())


def test_vectors_are_kept_once_and_met_as_keys(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(600, 16)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k bigint, v array<float>")
    kept = []

    def noted(rows):
        rows = plain(rows)
        kept.append(rows.count() if "v" in rows.columns else 0)
        return rows

    plain = hashing.materialize
    monkeypatch.setattr(hashing, "materialize", noted)
    slim = hashing.hashed_neighbours(df, "k", F.col("v"), 3, bucket_points=100, vectors=False)
    got = {r.k: [(n.id, n.distance) for n in r.neighbours] for r in slim.collect()}
    assert max(kept) == 600 and "v" not in slim.schema["neighbours"].dataType.elementType.names
    wide = hashing.hashed_neighbours(df, "k", F.col("v").cast("array<double>"), 3, bucket_points=100)
    full = {r.k: r.neighbours for r in wide.collect()}
    assert got == {k: [(n.id, n.distance) for n in near] for k, near in full.items()} and len(got) == 600
    assert all(n.v == x[n.id].astype(float).tolist() for n in full[7])


def test_few_buckets_are_searched_whole_and_once(vectors, monkeypatch):
    """Two buckets used to be searched by each of eight tables, eight buckets by half by each."""
    df, x = vectors
    visits = []
    monkeypatch.setattr(hashing, "Table", lambda number, *a, make=hashing.Table: visits.append(number) or make(number, *a))
    rows = df.where("k < 1500")
    found = hashing.hashed_neighbours(rows, "k", F.col("v"), 3, bucket_points=200).where("k % 10 = 0").collect()
    assert visits == [0] and len(found) == 150
    assert all([n.id for n in r.neighbours] == brute_force(x[:1500], r.k, 3)[0] for r in found)
    visits.clear()
    some = hashing.hashed_neighbours(rows, "k", F.col("v"), 3, tables=2, probes=2, bucket_points=100).where("k % 10 = 0").collect()
    hits = sum(len({n.id for n in r.neighbours} & set(brute_force(x[:1500], r.k, 3)[0])) for r in some)
    assert visits == [0, 1] and len(some) == 150 and hits / 450 >= 0.6


def test_closest_is_exact_where_the_matrix_product_rounds():
    rng = np.random.default_rng(5)
    x = 1e6 + rng.integers(0, 3, size=(300, 8)) * 1e-3  # the product's rounding is far above these distances
    block = hashing.pd.DataFrame({"v": list(x), "ids": [[i] for i in range(300)]})
    got = hashing._closest(x[:40], np.arange(40), block, 4)
    for row in range(40):
        d2 = np.zeros(300)
        for axis in range(8):
            d2 += (x[row, axis] - x[:, axis]) ** 2
        want = sorted((d, i) for i, d in enumerate(d2))[:4]
        mine = got[got.qid == row]
        assert list(zip(mine.d2, mine.id)) == want
