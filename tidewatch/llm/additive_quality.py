"""Quality score by a generalised additive model with pairwise interactions.

Every text becomes a dozen numbers in one pass over the whole text. Each number
has a lookup table over quantile bins; training cycles through the tables and
adds to each the leaves of a shallow tree fitted to the current gradients, at a small
learning rate. Then the pairs of features whose joint bins explain most of what is
left get tables of their own, boosted the same way. A score is the sum of the looked-up
bins through the logistic function.

Training takes at most ``TRAIN_ROWS`` labelled rows, the first by a hash of the id; scoring
takes every row. Language, source and id are never inputs.

Defined results: null counts as empty, an empty text gets the score of its bins like
any other; labels that are null or of unknown documents are left out; repeated label
rows count repeatedly; without any training row, or with one class only, the score is
the share of label 1 (0.5 without rows); repeated documents get equal scores; an empty
table gives an empty result; other columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, free_name

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 40
RATE = 0.15
SHRINK = 2.0  # added to every leaf's curvature
LEAST_LEAF = 5.0  # rows a leaf must hold

FEATURES = (
    "log_words", "word_length", "longest_word", "upper", "digits", "marks", "shouts", "bars", "sentence_marks",
    "high_bytes", "distinct_words", "neighbour_repeats", "commonest_word", "repeated_lines", "line_words", "squeezed",
)

_MARKS = np.frombuffer(b"#*$%&<>@^~\\", np.uint8)
_ENDS = np.frombuffer(b".,;:?", np.uint8)


def features(text: str) -> list[float]:
    """Counts of the whole text, as shares of its words, letters or bytes."""
    raw = text.encode("utf-8", "replace")
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    counts = Counter(words)
    per = max(1, n)
    spaces = int(byte[[9, 10, 11, 12, 13, 32]].sum())
    return [
        math.log1p(n),
        (len(raw) - spaces) / per,
        float(max(map(len, words), default=0)),
        upper / max(1, upper + lower),
        int(byte[48:58].sum()) / size,
        int(byte[_MARKS].sum()) / per,
        int(byte[33]) / per,
        int(byte[124]) / per,
        int(byte[_ENDS].sum()) / per,
        int(byte[128:].sum()) / size,
        len(counts) / per,
        sum(map(eq, words, words[1:])) / per,
        max(counts.values(), default=0) / per,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        n / max(1, len(lines)),
        len(zlib.compress(raw, 1)) / size,
    ]


@dataclass
class AdditiveModel:
    """Bin edges and tables by feature and by pair of features."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, j], side="right")]
        for (a, b), (ea, eb, table) in self.pairs.items():
            z += table[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(nl < LEAST_LEAF) | (n.sum() - nl < LEAST_LEAF)] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Step for every bin from a tree of up to ``leaves`` leaves."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(cuts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of a tree that cuts one axis and then the other on either side."""
    best_gain, best = 0.0, np.zeros(g.shape)
    whole = _gain(g.sum(), h.sum())
    for turned in (False, True):
        G, H, N = (m.T if turned else m for m in (g, h, n))
        for cut in range(1, len(G)):
            step, total = np.zeros(G.shape), -whole
            for rows in (slice(0, cut), slice(cut, None)):
                gr, hr, nr = G[rows].sum(0), H[rows].sum(0), N[rows].sum(0)
                _, at = _best_cut(gr, hr, nr)
                for cols in (slice(0, at), slice(at, None)) if at else (slice(None),):
                    step[rows, cols] = gr[cols].sum() / (hr[cols].sum() + SHRINK)
                    total += _gain(gr[cols].sum(), hr[cols].sum())
            if total > best_gain + 1e-12:
                best_gain, best = total, step.T if turned else step
    return best_gain, best


def train(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit the tables to bounded training rows."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return AdditiveModel(math.log(share / (1 - share)))
    share = float(y.mean())
    model = AdditiveModel(math.log(share / (1 - share)))
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    place = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    rows = [np.bincount(p, minlength=len(t)) for p, t in zip(place, model.tables)]
    z = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-z))
            g = np.bincount(place[j], weights=y - p, minlength=len(table))
            h = np.bincount(place[j], weights=p * (1 - p), minlength=len(table))
            step = RATE * _tree(g, h, rows[j])
            table += step
            z += step[place[j]]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cell = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def grids(a: int, b: int, *weights: np.ndarray) -> list[np.ndarray]:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        flat = cell[a] * shape[1] + cell[b]
        return [np.bincount(flat, weights=w, minlength=shape[0] * shape[1]).reshape(shape) for w in weights]

    p = 1 / (1 + np.exp(-z))
    ones = np.ones(len(y))
    combos = [(a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])]
    gains = {ab: _pair_tree(*grids(*ab, y - p, p * (1 - p), ones))[0] for ab in combos}
    chosen = sorted(combos, key=lambda ab: -gains[ab])[:PAIRS]
    tables = {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            p = 1 / (1 + np.exp(-z))
            step = RATE * _pair_tree(*grids(a, b, y - p, p * (1 - p), ones))[1]
            tables[a, b] += step
            z += step[cell[a], cell[b]]
    model.pairs = {(a, b): (coarse[a], coarse[b], tables[a, b]) for a, b in chosen}
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], float).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Learn from labelled documents outside the held-out fold, ``train_rows`` at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    sample = (
        known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(train_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x = pa.array(_matrix(batch.column(1).to_pylist()).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], ["doc_id", "y", "x"])

    # The sample holds train_rows pairs of numbers at most, so it may be broadcast.
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")
    measured = joined.mapInArrow(run, "doc_id long, y int, x array<double>")
    found = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(train_rows).toPandas()
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    return train(x, found["y"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = pa.array(model.score(_matrix(batch.column(1).to_pylist())), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, all columns as they are."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts.tolist())))

    name = free_name(docs, "quality_score")
    good = docs.withColumn(name, scored(F.col("text").cast("string"))).where(F.col(name) >= threshold)
    return good.select(*[F.col(f"`{c}`") for c in docs.columns])
