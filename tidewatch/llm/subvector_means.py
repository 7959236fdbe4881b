"""K-means over integer vectors through dictionaries of subvectors.

Vectors are dictionary-encoded once and without loss: a chunk of vectors is cut into blocks
of dimensions, each block keeps its distinct subvectors and every vector becomes one code a
block. The block width is the one whose dictionary and codes cost the fewest operations for
this chunk: copies and coarse values share wide blocks, unrelated vectors narrow ones.

A round computes the distance of each distinct subvector from each centroid's part once,
adds these partial distances by code, and counts codes by cluster: a cluster's sum is its
code counts times the dictionary. All arithmetic is exact. Tasks send one total a
component and cluster, so neither the driver nor a group grows with the vectors, and a
chunk's dictionary never leaves the chunk.

Defined results: vectors of another length, null, or with a null or non-finite component take no
part, nor do those with a component of 2^63 or more after scaling, which no long can hold.
Repeated rows count each on its own; a null id takes part and comes last among the starts; with
fewer vectors than clusters each is a start; an empty table gives no row. Equal distances go to
the smaller number, equal hashes of starts to the smaller vector. Distances and their sums
that pass the range of a long stop at its end. Other columns are ignored. A vector's length is
fixed, so there are no long ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1_024
SEED = 3
CHUNK = 4_096  # vectors that share dictionaries; codes fit 16 bits
EXACT = 2**61  # up to this sum of squared components a squared distance fits a long
LONG_MAX = 2**63 - 1

ENCODED = "ids array<long>, width int, sizes array<int>, entries array<long>, codes binary"
TOTALS = "cluster int, place int, total decimal(38,0)"
ASSIGNED = (
    "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
)


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)`` with integer components of the vectors that take part."""
    # NaN is larger than any number to Spark, so it fails the test as infinity does.
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) * scale < 2.0**63, F.lit(False)))
    return vectors.where((F.size("embedding") == dimensions) & fits).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )


def encode(vectors: np.ndarray) -> tuple[int, list[np.ndarray], np.ndarray]:
    """Block width, the distinct subvectors of every block, and the code of each vector in each block."""
    rows, dimensions = vectors.shape
    best = None
    width = 1
    while dimensions % width == 0:
        blocks = [np.ascontiguousarray(vectors[:, i : i + width]) for i in range(0, dimensions, width)]
        found = [np.unique(b.view([("", b.dtype)] * width).ravel(), return_inverse=True) for b in blocks]
        # A component of an entry costs a subtraction, a square and an addition, a code one addition.
        cost = 3 * sum(len(d) for d, _ in found) * width + rows * len(blocks)
        if best is None or cost < best[0]:
            best = cost, width, found
        width *= 2
    _, width, found = best
    entries = [d.view(vectors.dtype).reshape(-1, width) for d, _ in found]
    return width, entries, np.stack([c.ravel() for _, c in found], axis=1)


def encoded(kept: DataFrame) -> DataFrame:
    """One row a chunk: ids, dictionaries and codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                width, entries, codes = encode(vectors)
                columns = [
                    pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([width], pa.int32()),
                    pa.array([[len(e) for e in entries]], pa.list_(pa.int32())),
                    pa.array([np.concatenate([e.ravel() for e in entries])], pa.list_(pa.int64())),
                    pa.array([codes.astype("<u2").tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "width", "sizes", "entries", "codes"])

    return kept.mapInArrow(run, ENCODED)


class Chunk:
    """A decoded row of the encoded table."""

    def __init__(self, row: pa.RecordBatch) -> None:
        self.ids = row.column(0).flatten()
        width = row.column(1)[0].as_py()
        self.sizes = row.column(2).flatten().to_numpy()
        self.entries = row.column(3).flatten().to_numpy().reshape(-1, width)
        local = np.frombuffer(row.column(4)[0].as_buffer(), dtype="<u2").reshape(len(self.ids), len(self.sizes))
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.codes = local + self.first

    def assign(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of every vector and the squared distance from it."""
        middle = np.array(centroids, dtype=object)
        entries = self.entries
        largest = max(np.abs(middle).max(), abs(int(entries.min())), abs(int(entries.max())))
        if middle.shape[1] * largest**2 <= EXACT:
            middle = middle.astype(np.int64)
        else:
            entries = entries.astype(object)
        width = entries.shape[1]
        parts = middle.reshape(len(centroids), -1, width).transpose(1, 0, 2)  # block, centroid, component
        block = np.repeat(np.arange(len(self.sizes)), self.sizes)
        partial = ((entries[:, None, :] - parts[block]) ** 2).sum(axis=2)
        distance = partial[self.codes[:, 0]]
        for b in range(1, len(self.sizes)):
            distance = distance + partial[self.codes[:, b]]
        label = distance.argmin(axis=1)
        return label, distance[np.arange(len(label)), label]

    def totals(self, label: np.ndarray, clusters: int) -> np.ndarray:
        """Componentwise sums of each cluster, from the counts of codes by cluster."""
        size = len(self.entries)
        counts = np.bincount((label[:, None] * size + self.codes).ravel(), minlength=clusters * size)
        counts = counts.reshape(clusters, size, 1)
        entries = self.entries
        if max(abs(int(entries.min())), abs(int(entries.max()))) > LONG_MAX // CHUNK:
            counts, entries = counts.astype(object), entries.astype(object)
        return np.add.reduceat(counts * entries, self.first, axis=1).reshape(clusters, -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(batch.slice(i, 1))


def round_totals(chunks: DataFrame, centroids: list[list[int]]) -> tuple[list[int], list[list[int]], list[int]]:
    """Vectors, componentwise sums and summed distances of every cluster."""
    k, dimensions = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dimensions + 2), dtype=object)
        for chunk in _chunks(batches):
            label, distance = chunk.assign(centroids)
            total[:, :dimensions] += chunk.totals(label, k).astype(object)
            total[:, dimensions] += np.bincount(label, minlength=k).astype(object)
            for c in range(k):
                total[c, dimensions + 1] += sum(min(int(d), LONG_MAX) for d in distance[label == c])
        cluster, place = np.nonzero(total)
        columns = [
            pa.array(cluster, pa.int32()),
            pa.array(place, pa.int32()),
            pa.array([Decimal(int(x)) for x in total[cluster, place]], pa.decimal128(38, 0)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "total"])

    found = np.zeros((k, dimensions + 2), dtype=object)
    sums = chunks.mapInArrow(run, TOTALS).groupBy("cluster", "place").agg(F.sum("total").alias("total"))
    for r in sums.collect():  # clusters times components
        found[r.cluster, r.place] = int(r.total)
    return found[:, dimensions].tolist(), found[:, :dimensions].tolist(), found[:, dimensions + 1].tolist()


def cluster(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
) -> DataFrame:
    """One row a kept vector: its cluster, squared distance, summed distances and its centroid's digest.

    ``vectors`` holds ``vec_id`` and ``embedding``. Centroids start as the vectors with the smallest
    SHA-256 of seed and id. Rounds end early once no centroid moves: the rest would repeat.
    """
    kept = kept_vectors(vectors, dimensions, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters)
    centroids = [list(r.v) for r in starts.collect()]  # `clusters` rows
    spark = vectors.sparkSession
    if not centroids:
        return spark.createDataFrame([], ASSIGNED)
    chunks = materialize(encoded(kept))
    for _ in range(rounds):
        counts, sums, _ = round_totals(chunks, centroids)
        moved = [[s // n for s in total] if n else old for n, total, old in zip(counts, sums, centroids)]
        if moved == centroids:
            break
        centroids = moved
    _, _, inertia = round_totals(chunks, centroids)
    by_cluster = np.array([min(i, LONG_MAX) for i in inertia], dtype=np.int64)
    overall = min(sum(inertia), LONG_MAX)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            label, distance = chunk.assign(centroids)
            columns = [
                chunk.ids,
                pa.array(label, pa.int32()),
                pa.array([min(int(d), LONG_MAX) for d in distance], pa.int64()),
                pa.array(by_cluster[label]),
                pa.array(np.full(len(label), overall)),
                pa.array([digests[c] for c in label]),
            ]
            names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return chunks.mapInArrow(run, ASSIGNED)
