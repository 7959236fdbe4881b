"""Exact k nearest neighbours and minority oversampling.

The space is cut into cells of similar size, so no task sees all points and no
pair list is built. Each point searches its own cell; only when the ball
around it reaches into another cell is it sent there. Equal points are one
point with a short list of keys, so a heavily repeated point is not hot.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators.joins import lookup_join
from tidewatch.operators.ordered import number_rows
from tidewatch.session import materialize

CELL_POINTS = 10_000
SAMPLE_PER_CELL = 16
MAX_DEPTH = 16  # at most 65,536 cells; the driver then holds about two million sampled points
COPIES_AT_ONCE = 1_000
DISTANCES = 2_000_000  # size of one block of distances in a task


class Cells:
    """Nested cuts of the space, learnt from a bounded sample.

    A cut lies between two different values, on the axis where it divides the points
    most evenly, so both sides hold points as long as a cell has two different ones.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(2**depth, dtype=int)
        self.cut = np.zeros(2**depth)
        parts = {1: sample}
        for node in range(1, 2**depth):
            part = parts.pop(node)
            self.axis[node], self.cut[node] = self._cut(part)
            right = part[:, self.axis[node]] > self.cut[node]
            parts[2 * node], parts[2 * node + 1] = part[~right], part[right]

    @staticmethod
    def _cut(part: np.ndarray) -> tuple[int, float]:
        best = (0, 0.0, 0, np.inf)  # smaller side, spread, axis, cut; without a cut all points stay left
        for axis in range(part.shape[1]):
            values, n = np.unique(part[:, axis], return_counts=True)
            if len(values) < 2:
                continue
            left = np.cumsum(n)[:-1]
            smaller = np.minimum(left, len(part) - left)
            at = int(np.argmax(smaller))
            cut = values[at] + (values[at + 1] - values[at]) / 2
            if not values[at] <= cut < values[at + 1]:
                cut = values[at]
            best = max(best, (int(smaller[at]), float(values[-1] - values[0]), axis, float(cut)))
        return best[2], best[3]

    def locate(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=int)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + (x[rows, self.axis[node]] > self.cut[node])
        return node

    def reached(self, x: np.ndarray, squared_radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs of all cells that the ball around each point touches."""
        rows, nodes = np.arange(len(x)), np.ones(len(x), dtype=int)
        # squared gap to the node's box, kept per axis
        gaps = np.zeros_like(x)
        for _ in range(self.depth):
            axis, cut = self.axis[nodes], self.cut[nodes]
            offset = x[rows, axis] - cut
            children = []
            for side in (0, 1):
                outside = offset > 0 if side == 0 else offset <= 0
                child = gaps.copy()
                at = np.arange(len(rows))
                child[at, axis] = np.where(outside, np.maximum(child[at, axis], np.abs(offset)), child[at, axis])
                keep = (child**2).sum(axis=1) <= squared_radius[rows] * (1 + 1e-9)
                children.append((rows[keep], 2 * nodes[keep] + side, child[keep]))
            rows, nodes, gaps = (np.concatenate(part) for part in zip(*children))
        return rows, nodes


def _closest(queries: np.ndarray, qids: np.ndarray, cell: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest keys of a cell for each query, by (distance, key)."""
    points = np.stack(cell["v"].to_numpy())
    ids = cell["ids"].to_numpy()
    found = []
    chunk = max(1, DISTANCES // len(points))
    for lo in range(0, len(queries), chunk):
        q = queries[lo : lo + chunk]
        d2 = np.zeros((len(q), len(points)))
        for axis in range(q.shape[1]):
            d2 += (q[:, None, axis] - points[None, :, axis]) ** 2
        nth = min(k, len(points)) - 1
        limit = np.partition(d2, nth, axis=1)[:, nth]
        row, col = np.nonzero(d2 <= limit[:, None])
        part = pd.DataFrame({"qid": qids[lo + row], "d2": d2[row, col], "id": ids[col], "v": list(points[col])})
        part = part.explode("id", ignore_index=True)
        part["id"] = part["id"].astype("int64")
        found.append(part.sort_values(["qid", "d2", "id"]).groupby("qid", sort=False).head(k))
    return pd.concat(found, ignore_index=True)


def nearest_neighbours(
    df: DataFrame, key: str, features: Sequence[str], k: int = 5, cell_points: int = CELL_POINTS
) -> DataFrame:
    """``(key, neighbours)``: up to k ``(id, distance, v)`` records in order, nearest first, ties by key.

    ``key`` is a unique integer. Rows with a missing feature have no neighbours
    and are left out.
    """
    vector = F.array(*[F.col(c).cast("double") for c in features])
    points = df.select(F.col(key).cast("bigint").alias("id"), vector.alias("v")).dropna(subset=["id"])
    points = points.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    # One more than k keys of an equal point can ever matter; Spark prunes to that before the shuffle.
    same = Window.partitionBy("v").orderBy("id")
    distinct = (
        points.withColumn("_row", F.row_number().over(same))
        .where(F.col("_row") <= k + 1)
        .groupBy("v")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    distinct = materialize(distinct)
    total = distinct.count()
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total / cell_points)))))
    wanted = SAMPLE_PER_CELL * 2**depth
    share = min(1.0, 2 * wanted / max(1, total))
    sampled = distinct.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    axes = [F.get("v", F.lit(i)).alias(f"x{i}") for i in range(len(features))]
    sample = sampled.select(*axes).toPandas().to_numpy() if depth else np.empty((0, len(features)))
    cells = Cells(sample, depth)

    @F.pandas_udf("bigint")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(cells.locate(np.stack(v.to_numpy())))

    placed = materialize(distinct.withColumn("cell", cell_of("v")))
    need = k + 1

    def search_own(cell: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(cell["v"].to_numpy())
        qids = cell["ids"].str[0].to_numpy(dtype="int64")
        near = _closest(points, qids, cell, need)
        near["cell"] = 0
        stats = near.groupby("qid")["d2"].agg(["size", "max"]).reindex(qids)
        radius = np.where(stats["size"].to_numpy() >= need, stats["max"].to_numpy(), np.inf)
        row, other = cells.reached(points, radius)
        away = other != int(cell["cell"].iloc[0])
        row, other = row[away], other[away]
        reach = pd.DataFrame({"qid": qids[row], "d2": radius[row], "id": 0, "v": list(points[row]), "cell": other})
        return pd.concat([near, reach], ignore_index=True)[["qid", "id", "d2", "v", "cell"]]

    schema = "qid bigint, id bigint, d2 double, v array<double>, cell bigint"
    first = materialize(placed.groupBy("cell").applyInPandas(search_own, schema))
    own, visits = first.where(F.col("cell") == 0), first.where(F.col("cell") != 0)

    # A cell visited by many points is searched in several tasks.
    shares = visits.groupBy("cell").agg(F.ceil(F.count("*") / cell_points).alias("shares"))
    queries = visits.join(shares, "cell").withColumn("share", F.pmod(F.xxhash64("qid"), F.col("shares")))
    targets = placed.join(shares, "cell").withColumn(
        "share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1))
    )

    def search_other(asked: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or cell.empty:
            return pd.DataFrame({"qid": [], "id": [], "d2": [], "v": []})
        near = _closest(np.stack(asked["v"].to_numpy()), asked["qid"].to_numpy(), cell, need)
        return near[["qid", "id", "d2", "v"]]

    other = (
        queries.select("cell", "share", "qid", "v")
        .groupBy("cell", "share")
        .cogroup(targets.select("cell", "share", "v", "ids").groupBy("cell", "share"))
        .applyInPandas(search_other, "qid bigint, id bigint, d2 double, v array<double>")
    )
    best = Window.partitionBy("qid").orderBy("d2", "id")
    lists = (
        own.select("qid", "id", "d2", "v")
        .unionByName(other)
        .withColumn("_row", F.row_number().over(best))
        .where(F.col("_row") <= need)
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("d2", "id", "v"))).alias("near"))
    )
    by_vector = distinct.select("v", F.col("ids")[0].alias("qid")).join(lists, "qid").select("v", "near")
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k)
    return lookup_join(points, by_vector, ["v"]).select(
        F.col("id").alias(key),
        F.transform(
            others, lambda n: F.struct(n["id"].alias("id"), F.sqrt(n["d2"]).alias("distance"), n["v"].alias("v"))
        ).alias("neighbours"),
    )


def _uniform(*parts) -> F.Column:
    """A repeatable number in [0, 1) from a hash of the parts."""
    digits = F.substring(F.md5(F.concat_ws("-", *[F.lit(p) if isinstance(p, str) else p for p in parts])), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(2**32)


def oversample_minority(
    df: DataFrame, label: str, key: str, features: Sequence[str], k: int = 5, seed: int = 42
) -> DataFrame:
    """Add synthetic rows x + u (neighbour - x) until both classes have the same size.

    Synthetic rows have a null key. Which neighbour and which u are taken
    follows from a hash of the row's key, so a recomputed task gives the same rows.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().limit(3).collect()}
    if len(counts) != 2:
        raise ValueError("oversampling needs exactly two classes")
    small, large = sorted(counts, key=counts.get)
    missing = counts[large] - counts[small]
    base = df.select(F.col(label), F.col(key).cast("bigint").alias(key), *[F.col(c).cast("double").alias(c) for c in features])
    original = base.withColumn("is_synthetic", F.lit(False))
    if missing == 0:
        return original
    near = nearest_neighbours(base.where(F.col(label) == small), key, features, k).where(F.size("neighbours") > 0)
    near = materialize(near)
    usable = near.count()
    if usable == 0:
        raise ValueError("the minority class has no two complete rows")
    # Rows 1..missing % usable get one copy more than the others.
    numbered = number_rows(near, key, "_number")
    copies = F.lit(missing // usable) + (F.col("_number") <= F.lit(missing % usable)).cast("int")
    # Two steps, so that no row builds a list as long as the classes are uneven.
    blocks = numbered.withColumn("_copies", copies.cast("bigint")).where("_copies > 0").select(
        key, "neighbours", "_copies", F.explode(F.expr(f"sequence(1, _copies, {COPIES_AT_ONCE})")).alias("_from")
    )
    last = F.least(F.col("_copies"), F.col("_from") + (COPIES_AT_ONCE - 1))
    drawn = blocks.select(key, "neighbours", F.explode(F.sequence("_from", last)).alias("_copy"))
    pick = F.floor(_uniform(f"n{seed}", F.col(key), F.col("_copy")) * F.size("neighbours")) + 1
    synthetic = (
        drawn.join(base.where(F.col(label) == small).select(key, *features), key)
        .withColumn("_other", F.element_at("neighbours", pick.cast("int"))["v"])
        .withColumn("_u", _uniform(f"u{seed}", F.col(key), F.col("_copy")))
        .select(
            F.lit(small).cast(df.schema[label].dataType).alias(label),
            F.lit(None).cast("bigint").alias(key),
            *[(F.col(c) + F.col("_u") * (F.col("_other")[i] - F.col(c))).alias(c) for i, c in enumerate(features)],
            F.lit(True).alias("is_synthetic"),
        )
    )
    return original.unionByName(synthetic)
