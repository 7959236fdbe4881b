"""Approximate k nearest neighbours of wide vectors by hash tables.

The exact search of :mod:`tidewatch.operators.neighbours` follows a ball through cells; with
many dimensions that ball touches all of them. Here each table projects the vectors on a few
random directions and cuts the projections into buckets of about equal size. A vector looks into
the nearest buckets of every table, and the best of what it meets are its neighbours. What is
missed is missed by the projections; no bucket is cut short.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from tidewatch.operators.joins import lookup_join
from tidewatch.operators.neighbours import CELL_POINTS, DISTANCES, SAMPLE_PER_CELL, Cells
from tidewatch.session import materialize

TABLES = 8
PROBES = 4  # buckets of a table that a vector looks into, its own included
DIRECTIONS = 24  # random directions of a table; each cut takes one of them
MAX_DEPTH = 14  # cuts learnt on the driver, from about 262,144 sampled projections; larger buckets are searched in blocks
FEW_PAIRS = 256
VISITS = 4  # visitors a bucket block takes in one task, in multiples of its points


class Table:
    """Random directions and nested cuts along them."""

    def __init__(self, number: int, seed: int, width: int, sample: np.ndarray, depth: int) -> None:
        self.directions = np.random.default_rng([seed, number]).normal(size=(width, DIRECTIONS)) / math.sqrt(width)
        self.cells = Cells(sample @ self.directions, depth)

    def probes(self, x: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, buckets): the ``wanted`` buckets whose boxes lie nearest in the projection, the own one among them."""
        y = x @ self.directions
        rows = np.arange(len(y))[:, None]
        nodes, gaps = np.ones((len(y), 1), dtype=int), np.zeros((len(y), 1))
        for _ in range(self.cells.depth):
            offset = y[rows, self.cells.axis[nodes]] - self.cells.cut[nodes]
            # The side that the point lies on costs nothing, the other one its distance to the cut.
            left = gaps + np.where(offset > 0, offset**2, 0.0)
            right = gaps + np.where(offset <= 0, offset**2, 0.0)
            nodes, gaps = np.concatenate([2 * nodes, 2 * nodes + 1], axis=1), np.concatenate([left, right], axis=1)
            # The own child must win a tie with a cut that the point lies on.
            gaps[np.concatenate([offset <= 0, offset > 0], axis=1) & (gaps == 0)] = -1.0
            keep = np.argsort(gaps, axis=1, kind="stable")[:, :wanted]
            nodes, gaps = np.take_along_axis(nodes, keep, 1), np.maximum(np.take_along_axis(gaps, keep, 1), 0.0)
        return np.repeat(np.arange(len(y)), nodes.shape[1]), nodes.ravel()


def _closest(queries: np.ndarray, qids: np.ndarray, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest keys of a block for each query, by (distance, key).

    A matrix product finds who may be among them, up to its rounding; distances are then taken exactly.
    """
    points, ids = np.stack(block["v"].to_numpy()).astype(float), block["ids"].to_numpy()
    squares, turned = (points**2).sum(axis=1), -2.0 * points.T
    nth, chunk, found = min(k, len(points)) - 1, max(1, DISTANCES // len(points)), []
    for lo in range(0, len(queries), chunk):
        q = queries[lo : lo + chunk]
        own = (q**2).sum(axis=1)
        about = q @ turned
        about += squares
        error = 8 * q.shape[1] * np.finfo(float).eps * (own + squares.max())
        limit = np.partition(about, nth, axis=1)[:, nth] + 2 * error
        row, col = np.nonzero(about <= limit[:, None])
        d2 = np.zeros(len(row))
        for axis in range(q.shape[1]):
            d2 += (q[row, axis] - points[col, axis]) ** 2
        part = pd.DataFrame({"qid": qids[lo + row], "id": ids[col], "d2": d2}).explode("id", ignore_index=True)
        part["id"] = part["id"].astype("int64")
        found.append(part.sort_values(["qid", "d2", "id"]).groupby("qid", sort=False).head(k))
    return pd.concat(found, ignore_index=True)


def hashed_neighbours(
    df: DataFrame,
    key: str,
    vector: Column,
    k: int = 5,
    tables: int = TABLES,
    probes: int = PROBES,
    bucket_points: int = CELL_POINTS,
    seed: int = 42,
    vectors: bool = True,
) -> DataFrame:
    """``(key, neighbours)``: up to k ``(id, distance, v)`` records in order, nearest first, ties by key.

    Vectors go once to each block that searches them, as wide as they are stored; what is met there are keys and
    distances. ``vectors=False`` leaves out ``v`` and the join that looks it up.

    ``key`` is a unique integer, ``vector`` an array column. Distances are exact; a neighbour that shares no probed
    bucket is missed, so recall depends on ``tables`` and ``probes``. Up to ``bucket_points * tables * probes`` distinct
    vectors the result is exact: so few buckets would be visited about as often as all points have to be, and are one.

    Vectors that are null, empty or hold a missing or infinite value have no neighbours and are left out; vectors
    meet only those of the most frequent length (ties: the shorter). Equal vectors are hashed once.
    """
    points = df.select(F.col(key).cast("bigint").alias("id"), vector.alias("v"))
    if points.schema["v"].dataType != ArrayType(FloatType(), points.schema["v"].dataType.containsNull):
        points = points.withColumn("v", F.col("v").cast("array<double>"))
    points = points.where(F.col("id").isNotNull() & (F.size("v") > 0))
    points = points.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    same = Window.partitionBy("v").orderBy("id")
    distinct = (
        points.withColumn("_row", F.row_number().over(same))
        .where(F.col("_row") <= k + 1)  # one more than k keys of an equal vector can ever matter
        .groupBy("v")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    distinct = materialize(distinct)
    lengths = distinct.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.col("n").desc(), "width").first()
    width, total = (usual["width"], usual["n"]) if usual else (0, 0)
    distinct = distinct.where(F.size("v") == width)
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total / bucket_points)))))
    if 2**depth <= tables * probes:  # all pairs of blocks are no more work than the visits, and miss nothing
        depth = 0
    if depth == 0:
        tables = 1
    share = min(1.0, 2 * SAMPLE_PER_CELL * 2**depth / max(1, total))
    sampled = distinct.where(F.pmod(F.xxhash64(F.col("v").cast("array<double>")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    picked = sampled.select("v").toPandas()["v"] if depth else []  # at most about 32 * 2^MAX_DEPTH vectors
    sample = np.stack(list(picked)).astype(float) if len(picked) else np.empty((0, width))
    made = [Table(t, seed, width, sample, depth) for t in range(tables)]
    need = k + 1

    @F.pandas_udf("array<struct<tab: int, bucket: bigint, own: boolean>>")
    def visited(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        out: list[list[dict]] = [[] for _ in range(len(x))]
        for t, one in enumerate(made):
            own = one.cells.locate(x @ one.directions)
            for row, bucket in zip(*(a.tolist() for a in one.probes(x, probes))):
                out[row].append({"tab": t, "bucket": bucket, "own": bucket == int(own[row])})
        return pd.Series(out)

    places = materialize(distinct.select(F.element_at("ids", 1).alias("qid"), "v", "ids", visited("v").alias("places")))
    # Both sides of a bucket are cut into blocks, so that a task's input is bounded whatever a bucket holds.
    sizes = places.select(F.inline("places")).groupBy("tab", "bucket").agg(
        F.ceil(F.count_if("own") / bucket_points).alias("blocks"),
        F.ceil(F.count("*") / (VISITS * bucket_points)).alias("shares"),
    ).where(F.col("blocks") > 0)
    sizes = materialize(sizes)  # at most tables * 2^MAX_DEPTH rows
    visits = places.select("qid", "v", "ids", F.inline("places"))
    sized = visits.join(F.broadcast(sizes), ["tab", "bucket"])
    # Few bytes are much work here: as many tasks as there are pairs of blocks.
    pairs = sizes.agg(F.sum(F.col("blocks") * F.col("shares"))).first()[0] or 1
    pairs = 4 * pairs if pairs < FEW_PAIRS else pairs  # so that few of them meet in one task
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    asked = sized.select(
        "tab", "bucket", "qid", "v", F.pmod(F.xxhash64("qid"), F.col("shares")).alias("share"),
        F.explode(F.sequence(zero, F.col("blocks") - one)).alias("block"),
    )
    held = sized.where("own").select(
        *[F.col(c).alias(c) for c in ("tab", "bucket", "v", "ids")],  # new columns, so that the sides differ
        F.pmod(F.xxhash64("qid", F.lit(1)), F.col("blocks")).alias("block"),
        F.explode(F.sequence(zero, F.col("shares") - one)).alias("share"),
    )

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"qid": [], "id": [], "d2": []})
        return _closest(np.stack(queries["v"].to_numpy()).astype(float), queries["qid"].to_numpy(), block, need)

    keys = ["tab", "bucket", "block", "share"]
    asked, held = asked.repartition(pairs, *keys), held.repartition(pairs, *keys)
    met = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, "qid bigint, id bigint, d2 double")
    # A neighbour met in several tables is one neighbour, at the same distance.
    once = F.array_distinct(F.collect_list(F.struct("d2", "id")))
    lists = met.groupBy("qid").agg(F.slice(F.array_sort(once), 1, need).alias("near"))
    if vectors:
        held_by = points.select("id", F.col("v").cast("array<double>").alias("v"))
        lists = lists.select("qid", F.inline("near")).join(held_by, "id").groupBy("qid").agg(
            F.array_sort(F.collect_list(F.struct("d2", "id", "v"))).alias("near")
        )
    by_vector = places.select("v", "qid").join(lists, "qid").select("v", "near")
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k)
    shown = lambda n: [n["id"].alias("id"), F.sqrt(n["d2"]).alias("distance"), *([n["v"].alias("v")] if vectors else [])]
    return lookup_join(points.where(F.size("v") == width), by_vector, ["v"]).select(
        F.col("id").alias(key), F.transform(others, lambda n: F.struct(*shown(n))).alias("neighbours")
    )
