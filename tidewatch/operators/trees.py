"""Forests and boosted trees grown from counted cells.

Trees only see the bin that a value falls in, so rows of the same bins are one cell with a count for each
label. Spark's trainer runs one job for each level of each tree; here the rows are binned and counted once, and
whole trees grow inside tasks. Cuts, gains, leaf values, residuals and pruning are those of Spark's trainer, and the
result is its model. Samples are drawn for all rows of a cell at once: the number of rows that a draw for
each single row would take.

Wide or sparse vectors, weights, several classes, categories of many levels and tables of more cells than
``MAX_ENTRIES`` allows are left to Spark's trainer.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize, scratch_path

MAX_FEATURES = 64
MAX_BINS = 256  # a bin is one byte
MAX_ENTRIES = 16_000_000  # cells times features that a task holds
SPLIT_ROWS = 100_000  # rows that the cuts between bins are learnt from (Spark: 10,000)
NO_GAIN = 1e-12  # share of a sum that rounding can make up

NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, "
    "rawCount: bigint, gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


class Cells:
    """Bins of the distinct cells, one row a feature, with the rows of label 0 and 1 learnt from and held out."""

    def __init__(self, cuts: list[np.ndarray], found) -> None:
        self.cuts = cuts
        found = found.sort_values("cell", ignore_index=True)  # the same order whatever the tasks were
        flat = np.frombuffer(b"".join(found["cell"]), dtype=np.uint8).reshape(len(found), len(cuts))
        self.bins = np.ascontiguousarray(flat.T)
        self.rows = found[["n0", "n1"]].to_numpy(dtype=np.int64).T.copy()
        self.held = found[["h0", "h1"]].to_numpy(dtype=np.int64).T.copy()


def cut_points(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Cuts between distinct values: all of them, or those closest to equal shares of the rows."""
    distinct, n = np.unique(values, return_counts=True)
    middle = (distinct[:-1] + distinct[1:]) / 2.0
    wanted = min(max_bins, len(values)) - 1
    if len(middle) <= wanted:
        return middle
    stride = len(values) / (wanted + 1)
    through, target, kept = np.cumsum(n), stride, []
    for i in range(len(middle)):
        if abs(through[i] - target) < abs(through[i + 1] - target):
            kept.append(middle[i])
            target += stride
    return np.array(kept)


def counted(
    rows: DataFrame, features: str, label: str, max_bins: int, seed: int, held: Column | None = None
) -> Cells | None:
    """Cells of the rows; those ``held`` out count apart and have no part in the cuts. None if Spark has to train."""
    held = F.lit(False) if held is None else held
    attributes = rows.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    if max_bins > MAX_BINS or any(len(a.get("vals", [0] * 3)) > 2 for a in attributes.get("nominal", [])):
        return None
    first = rows.select(features).first()
    if first is None or first[0] is None or not 0 < first[0].size <= MAX_FEATURES:
        return None
    size = first[0].size
    points = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), held.alias("held"))
    learnt = points.where(~F.col("held")).select("x")
    n = learnt.count()
    if n == 0:
        return None
    some = learnt if n <= SPLIT_ROWS else learnt.sample(SPLIT_ROWS / n, seed)
    x = np.stack(list(some.toPandas()["x"]))
    if np.isnan(x).any():
        return None
    cuts = [cut_points(x[:, j], max_bins) for j in range(size)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            out = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            bins = np.empty(x.shape, dtype=np.uint8)
            for j, cut in enumerate(cuts):
                bins[:, j] = np.searchsorted(cut, x[:, j], side="left")
            cells, at = np.unique(bins.view(np.dtype((np.void, x.shape[1]))).ravel(), return_inverse=True)
            parts = [(~out & (y == 0)), (~out & (y == 1)), (out & (y == 0)), (out & (y == 1))]
            odd = np.isnan(x).any(axis=1) | ((y != 0) & (y != 1))
            columns = [np.bincount(at, part, len(cells)).astype(np.int64) for part in (*parts, odd)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.tobytes() for c in cells], pa.binary()), *map(pa.array, columns)],
                ["cell", "n0", "n1", "h0", "h1", "odd"],
            )

    names = ["n0", "n1", "h0", "h1", "odd"]
    partial = points.mapInArrow(count, "cell binary, " + ", ".join(f"{c} bigint" for c in names))
    found = materialize(partial.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]))
    totals = found.agg(F.count("*").alias("cells"), *[F.sum(c).alias(c) for c in names]).first()
    if totals["odd"] or not totals["n0"] or not totals["n1"] or totals["cells"] * size > MAX_ENTRIES:
        return None
    return Cells(cuts, found.toPandas())


class Tree:
    """Nodes by level; children come after their parents. ``stats`` are count, sum and sum of squares."""

    def __init__(self) -> None:
        self.levels: list[dict[str, np.ndarray]] = []

    def add(self, stats: np.ndarray) -> None:
        m = stats.shape[1]
        none = np.full(m, -1)
        self.levels.append(
            {"stats": stats, "feature": none, "bin": none.copy(), "left": none.copy(), "gain": np.full(m, -1.0)}
        )

    def whole(self) -> dict[str, np.ndarray]:
        """One array for all levels; ``left`` is the left child's number, the right child is the next one."""
        first = np.cumsum([0] + [len(level["left"]) for level in self.levels])
        out = {k: np.concatenate([level[k] for level in self.levels], axis=-1) for k in self.levels[0]}
        shift = np.repeat(first[1:], np.diff(first))
        out["left"] = np.where(out["left"] >= 0, out["left"] + shift, -1)
        out["level"] = np.repeat(np.arange(len(self.levels)), np.diff(first))
        return out


def _scores(w, s, total_w, total_s, least):
    """What a cut adds to the sum of (sum squared / count), -inf where there is no cut."""
    rest_w, rest_s = total_w - w, total_s - s
    with np.errstate(divide="ignore", invalid="ignore"):
        both = s * s / w + rest_s * rest_s / rest_w
        gain = both - total_s * total_s / total_w
    return np.where((w >= least) & (rest_w >= least) & (gain > NO_GAIN * both), gain, -np.inf)


def _best_of_all(bins, node, w, s, total, size, least):
    """Best (gain, feature, bin) of each node over all features, the first one of equal ones."""
    m = total.shape[1]
    base = node * size
    found = np.empty((2, m, len(bins), size))
    for j, b in enumerate(bins):
        at = base + b
        found[0, :, j] = np.bincount(at, w, m * size).reshape(m, size)
        found[1, :, j] = np.bincount(at, s, m * size).reshape(m, size)
    np.cumsum(found, axis=3, out=found)
    gain = _scores(found[0], found[1], total[0][:, None, None], total[1][:, None, None], least).reshape(m, -1)
    best = gain.argmax(axis=1)
    return gain[np.arange(m), best], best // size, best % size


def _best_of_some(bins, node, w, s, total, size, least, chosen):
    """The same over the features ``chosen`` for each node, for whole numbers; empty bins take no space."""
    m, k = chosen.shape
    rows = np.arange(len(node))
    code = np.concatenate([(node * k + i) * size + bins[chosen[node, i], rows] for i in range(k)])
    w, s = np.tile(w, k), np.tile(s, k)
    if m * k * size <= 4 * len(code):
        uw, us = np.bincount(code, w, m * k * size), np.bincount(code, s, m * k * size)
        at = np.flatnonzero(uw)
        uw, us = uw[at], us[at]
    else:
        order = np.argsort(code)
        code = code[order]
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        at, uw, us = code[start], np.add.reduceat(w[order], start), np.add.reduceat(s[order], start)
    group = at // size
    opens = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    lengths = np.diff(np.concatenate([opens, [len(at)]]))
    cw, cs = np.cumsum(uw), np.cumsum(us)
    cw -= np.repeat((cw - uw)[opens], lengths)
    cs -= np.repeat((cs - us)[opens], lengths)
    owner = group // k
    gain = _scores(cw, cs, total[0][owner], total[1][owner], least)
    opens = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))  # every node holds rows
    most = np.maximum.reduceat(gain, opens)
    hit = np.flatnonzero(gain == most[owner])
    best = hit[np.unique(owner[hit], return_index=True)[1]]
    return most, chosen[np.arange(m), group[best] % k], at[best] % size


def grow(bins, size, w, s, squares, depth, least, least_gain, scale, features=None, rng=None) -> tuple[Tree, np.ndarray]:
    """A tree over cells of weight ``w`` and sum ``s``, and the number of the node that each cell ends in.

    ``features`` is how many are drawn for each node (None: all). Gains are ``scale`` times those of the variance.
    """
    tree, ends = Tree(), np.zeros(bins.shape[1], dtype=np.int64)
    rows = None  # all of them
    node, first = np.zeros(bins.shape[1], dtype=np.int64), 0
    m = 1
    for level in range(depth + 1):
        total = np.stack([np.bincount(node, x, m) for x in (w, s, squares)])
        tree.add(total)
        here = tree.levels[-1]
        if rows is None:
            ends[:] = node + first
        else:
            ends[rows] = node + first
        if level == depth or len(node) == 0:
            break
        if features is None or features >= len(bins):
            gain, feature, cut = _best_of_all(bins, node, w, s, total, size, least)
        else:
            chosen = np.sort(np.argsort(rng.random((m, len(bins))), axis=1)[:, :features], axis=1)
            gain, feature, cut = _best_of_some(bins, node, w, s, total, size, least, chosen)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = scale * gain / total[0]
        splits = (gain > 0) & (gain >= least_gain)
        if not splits.any():
            break
        here["feature"], here["bin"] = np.where(splits, feature, -1), np.where(splits, cut, -1)
        here["gain"] = np.where(splits, gain, -1.0)
        here["left"] = np.where(splits, 2 * (np.cumsum(splits) - 1), -1)
        first += m
        m = 2 * int(splits.sum())
        if not splits.all():
            on = np.flatnonzero(splits[node])
            rows = on if rows is None else rows[on]
            bins, node, w, s, squares = bins[:, on], node[on], w[on], s[on], squares[on]
        right = bins[here["feature"][node], np.arange(len(node))] > here["bin"][node]
        node = here["left"][node] + right
    return tree, ends


def _drawn(rng, rows: np.ndarray, share: float, replaced: bool) -> np.ndarray:
    """How many of the rows of each cell and label a sample holds."""
    if replaced:
        return rng.poisson(rows * share)
    return rows if share >= 1.0 else rng.binomial(rows, share)


def boost(cells: Cells, plan: Mapping, stages: Sequence[int] = ()) -> tuple[list[Tree], list[float]]:
    """Trees of ``plan['rounds']`` rounds of log loss, and the AUC on the held rows after each of the ``stages``."""
    bins = cells.bins.astype(np.int64)
    size = max(len(c) for c in cells.cuts) + 1
    score, trees, areas = np.zeros(bins.shape[1]), [], {}
    for i in range(plan["rounds"]):
        n0, n1 = _drawn(np.random.default_rng([plan["seed"] % 2**63, i]), cells.rows, plan["share"], False)
        up, down = (1.0, 1.0) if i == 0 else (4.0 / (1.0 + np.exp(2.0 * score)), 4.0 / (1.0 + np.exp(-2.0 * score)))
        w, s, squares = (n0 + n1).astype(float), n1 * up - n0 * down, n1 * up * up + n0 * down * down
        tree, ends = grow(bins, size, w, s, squares, plan["depth"], plan["least"], plan["least_gain"], 1.0)
        stats = np.concatenate([level["stats"] for level in tree.levels], axis=1)
        score += (1.0 if i == 0 else plan["step"]) * _means(stats)[ends]
        if not stages:
            trees.append(tree)
        if i + 1 in stages:
            areas[i + 1] = area_under_roc(score, *cells.held)
    return trees, [areas[n] for n in stages]


def _means(stats: np.ndarray) -> np.ndarray:
    return np.divide(stats[1], stats[0], out=np.zeros(stats.shape[1]), where=stats[0] > 0)


def area_under_roc(score: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> float:
    """Of rows given as counts of both labels for each score; equal scores count half."""
    below, above = n0.sum(), n1.sum()
    if not below or not above:
        return 0.0 if below else 1.0
    _, at = np.unique(score, return_inverse=True)
    c0, c1 = np.bincount(at, n0), np.bincount(at, n1)
    return float((c1 * (np.cumsum(c0) - c0 / 2.0)).sum() / (float(below) * float(above)))


def _batch(number: int, tree: Tree, cuts: list[np.ndarray], classes: bool) -> pa.RecordBatch:
    """A tree as Spark stores it. Two leaves of one prediction become one leaf, as in Spark's trainer."""
    t = tree.whole()
    count, ones, squares = t["stats"]
    if classes:
        stats, value = np.stack([count - ones, ones], axis=1), (2 * ones > count).astype(float)
        share = _means(t["stats"])
        impurity = 1.0 - (1.0 - share) ** 2 - share**2
    else:
        stats, value = np.stack([count, ones, squares], axis=1), _means(t["stats"])
        impurity = np.divide(squares - ones * value, count, out=np.zeros(len(count)), where=count > 0)
    left, gone = t["left"], np.zeros(len(count), dtype=bool)
    for level in range(int(t["level"][-1]) - 1, -1, -1):
        at = np.flatnonzero((t["level"] == level) & (left >= 0))
        child = left[at]
        at = at[(left[child] < 0) & (left[child + 1] < 0) & (value[child] == value[child + 1])]
        gone[left[at]] = gone[left[at] + 1] = True
        left[at] = -1
    kept, number_of = np.flatnonzero(~gone), np.cumsum(~gone) - 1
    left, feature = left[kept], t["feature"][kept]
    inner = left >= 0
    feature = np.where(inner, feature, -1).astype(np.int32)
    # Cuts lie at the ends of bins; a leaf has none.
    ends = np.concatenate([*cuts, [0.0]])
    starts = np.cumsum([0] + [len(c) for c in cuts])
    cut = ends[np.where(inner, starts[feature] + t["bin"][kept], len(ends) - 1)][inner]
    ints = lambda x: pa.array(x.astype(np.int32))
    split = pa.StructArray.from_arrays(
        [
            ints(feature),
            pa.ListArray.from_arrays(ints(np.concatenate([[0], np.cumsum(inner)])), pa.array(cut)),
            ints(np.full(len(kept), -1)),
        ],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    width = stats.shape[1]
    node = pa.StructArray.from_arrays(
        [
            ints(np.arange(len(kept))),
            pa.array(value[kept]),
            pa.array(impurity[kept]),
            pa.ListArray.from_arrays(ints(np.arange(len(kept) + 1) * width), pa.array(stats[kept].ravel())),
            pa.array(count[kept].astype(np.int64)),
            pa.array(np.where(inner, t["gain"][kept], -1.0)),
            ints(np.where(inner, number_of[left], -1)),
            ints(np.where(inner, number_of[left] + 1, -1)),
            split,
        ],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"],
    )
    return pa.RecordBatch.from_arrays([ints(np.full(len(kept), number)), node], ["treeID", "nodeData"])


def _stored(estimator, spark, nodes: DataFrame, size: int, weights: Sequence[float], kind: str, tree_kind: str) -> str:
    """Path of a model in Spark's format: parameters, nodes, and the weight of each tree."""
    path = scratch_path(spark, "trees")

    def described(name: str, uid: str, params: Mapping, defaults: Mapping, **more) -> str:
        head = {"class": f"org.apache.spark.ml.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        return json.dumps(head | {"uid": uid, "paramMap": params, "defaultParamMap": defaults} | more)

    named = [{p.name: v for p, v in given.items()} for given in (estimator._paramMap, estimator._defaultParamMap)]
    more = {"numFeatures": size, "numTrees": len(weights)} | ({} if tree_kind.startswith("regression") else {"numClasses": 2})
    text = described(f"classification.{kind}", estimator.uid, *named, **more)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(i, described(tree_kind, f"{estimator.uid}_{i}", {}, {}), float(w)) for i, w in enumerate(weights)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes.write.parquet(f"{path}/data")
    return path


def _plain(estimator) -> bool:
    """No settings but those that the trees here follow."""
    odd = [p for p in ("weightCol", "validationIndicatorCol") if estimator.hasParam(p) and estimator.isSet(p)]
    return not odd and estimator.getMinWeightFractionPerNode() == 0.0


def boosting_plan(estimator: GBTClassifier, params: Mapping | None = None) -> dict | None:
    """What a fit needs to know, or None if Spark has to train."""
    e = estimator.copy(params or {})
    if not _plain(e) or e.getFeatureSubsetStrategy() != "all":
        return None
    return {
        "rounds": e.getMaxIter(), "depth": e.getMaxDepth(), "step": e.getStepSize(), "share": e.getSubsamplingRate(),
        "least": e.getMinInstancesPerNode(), "least_gain": e.getMinInfoGain(), "seed": e.getSeed(),
    }


def _counted_once(estimator, rows: DataFrame) -> Cells | None:
    """Cells for a fit; the rows are read several times but made once."""
    features, label = estimator.getFeaturesCol(), estimator.getLabelCol()
    kept = rows.select(features, label).persist()
    try:
        return counted(kept, features, label, estimator.getMaxBins(), estimator.getSeed())
    finally:
        kept.unpersist()


class BoostedTrees(GBTClassifier):
    """Spark's boosted trees; all rounds grow in one task from counted cells."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        plan = boosting_plan(self)
        cells = plan and _counted_once(self, dataset)
        if not cells:
            return super()._fit(dataset)
        spark = dataset.sparkSession
        sent = spark.sparkContext.broadcast(cells)

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if sum(batch.num_rows for batch in batches):
                for i, tree in enumerate(boost(sent.value, plan)[0]):
                    yield _batch(i, tree, sent.value.cuts, False)

        weights = [1.0] + [plan["step"]] * (plan["rounds"] - 1)
        nodes = spark.range(0, 1, 1, 1).mapInArrow(grown, NODES)
        path = _stored(
            self, spark, nodes, len(cells.cuts), weights, "GBTClassificationModel", "regression.DecisionTreeRegressionModel"
        )
        sent.unpersist()
        return GBTClassificationModel.load(path)


class Forest(RandomForestClassifier):
    """Spark's random forest; each tree grows in one task from counted cells."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        trees, strategy, cells = self.getNumTrees(), self.getFeatureSubsetStrategy(), None
        if _plain(self) and self.getImpurity() == "gini" and strategy in ("auto", "sqrt", "all"):
            cells = _counted_once(self, dataset)
        if not cells:
            return super()._fit(dataset)
        spark, size = dataset.sparkSession, len(cells.cuts)
        some = None if strategy == "all" or (strategy == "auto" and trees == 1) else math.ceil(math.sqrt(size))
        seed, share, replaced = self.getSeed() % 2**63, self.getSubsamplingRate(), self.getBootstrap()
        depth, least, least_gain = self.getMaxDepth(), self.getMinInstancesPerNode(), self.getMinInfoGain()
        sent = spark.sparkContext.broadcast(cells)

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number in (i for batch in batches for i in batch.column(0).to_pylist()):
                cells = sent.value
                rng = np.random.default_rng([seed, number])
                n0, n1 = _drawn(rng, cells.rows, share, replaced)
                at = np.flatnonzero(n0 + n1)
                w, ones = (n0 + n1)[at].astype(float), n1[at].astype(float)
                bins, width = cells.bins[:, at].astype(np.int64), max(len(c) for c in cells.cuts) + 1
                tree, _ = grow(bins, width, w, ones, ones, depth, least, least_gain, 2.0, some, rng)
                yield _batch(number, tree, cells.cuts, True)

        nodes = spark.range(0, trees, 1, trees).mapInArrow(grown, NODES)
        path = _stored(
            self, spark, nodes, size, [1.0] * trees, "RandomForestClassificationModel",
            "classification.DecisionTreeClassificationModel",
        )
        sent.unpersist()
        return RandomForestClassificationModel.load(path)
