"""Exact top-k inner products by KD-trees per shard.

Vectors are dealt to shards of bounded size. Each shard builds a KD-tree of
median splits with tight bounding boxes; a query goes best-first by the largest
inner product that a box can hold, and stops when no open box can beat its kth
score. First every query searches the shard it lies in; the kth score found there
travels with it to the other shards, where most boxes are closed from the start. There
the rows of a shard come first and build its tree once; the queries stream through it after them, so
a vector is sent once and a task holds one shard and a block of queries.

Defined results: vectors that are null, empty or hold null, NaN or infinite
components take no part; vectors meet only vectors of their own length; rows equal
in id and components count once; rows with the query's id are its own, and an id
with several vectors is one query that asks with each; ties go to the smaller id; a query with fewer candidates gets all of them; scores are exact
(past 2^53 in Python integers, and beyond 64 bits they are cut to the ends of the
range). A null id takes no part; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize

SHARD_ROWS = 16_384
QUERY_ROWS = 1_024  # queries whose bounds are worked out together, by one matrix product over all boxes
MOST_PARTS = 10_000  # tasks of the second step; beyond, a task takes several shards one after the other
LEAF_ROWS = 64
OUT = "query_id long, vec_id long, score long"
LEAST, MOST = -(2**63) + 1, 2**63 - 1  # ends of the scores; no score is below LEAST


def whole_components(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


class Tree:
    """Nodes in arrays: box, smallest id, children or a slice of the rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.lo, self.hi, self.first, self.parts = [], [], [], []
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self._build(np.arange(len(ids)), leaf_rows)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _build(self, members: np.ndarray, leaf_rows: int) -> None:
        todo = [(members, None, 0)]
        while todo:
            members, parent, side = todo.pop()
            node = len(self.first)
            block = self.rows[members]
            lo, hi = block.min(axis=0), block.max(axis=0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.first.append(int(self.ids[members].min()))
            self.parts.append(members)
            if parent is not None:
                self.parts[parent][side] = node
            if len(members) > leaf_rows and (hi > lo).any():
                axis = int(np.argmax(hi - lo))
                rank = np.argsort(block[:, axis], kind="stable")
                half = len(members) // 2
                self.parts[node] = [0, 0]
                todo += [(np.sort(members[rank[:half]]), node, 0), (np.sort(members[rank[half:]]), node, 1)]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Best rows of each query that reach the score ``known`` from other shards (as far as k of them)."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bounds = _product(up, self.hi) + _product(down, self.lo)
        for q in range(len(queries)):
            yield from self._one(int(own[q]), queries[q], bounds[q].tolist(), k, int(known[q]))

    def _one(self, own: int, query: np.ndarray, bounds: list[int], k: int, known: int) -> Iterator[tuple[int, int, int]]:
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst on top
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            bound = -bound
            if bound < known or len(best) == k and bound < best[0][0]:
                break
            if len(best) == k and bound == best[0][0] and self.first[node] > -best[0][1]:
                continue
            part = self.parts[node]
            if isinstance(part, list):
                for child in part:
                    heapq.heappush(queue, (-bounds[child], child))
                continue
            scores = _product(query[None, :], self.rows[part])[0]
            least = max(known, best[0][0]) if len(best) == k else known
            hit = np.flatnonzero((scores >= least) & (self.ids[part] != own))
            if len(hit) > k:  # ids ascend inside a leaf, so a stable sort keeps the smaller ids
                hit = hit[np.argsort(-scores[hit], kind="stable")[:k]]
            for i in hit.tolist():
                item = (int(scores[i]), -int(self.ids[part[i]]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        for score, negative in best:
            yield own, -negative, score


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles where all sums stay below 2^53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.minimum(np.maximum(a.astype(object) @ b.T.astype(object), LEAST), MOST)


def _found(tree: Tree, part: pd.DataFrame, k: int, query_rows: int = QUERY_ROWS) -> pd.DataFrame:
    rows: list[tuple[int, int, int]] = []
    for at in range(0, len(part), query_rows):
        block = part.iloc[at : at + query_rows]
        queries = np.stack([np.asarray(v, np.int64) for v in block["v"]])
        rows += tree.search(block["id"].to_numpy(), queries, k, block["known"].to_numpy())
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype=object).astype("int64")


def _tree(part: pd.DataFrame) -> Tree:
    return Tree(part["id"].to_numpy(np.int64), np.stack([np.asarray(v, np.int64) for v in part["v"]]))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every row where ``is_query`` holds."""
    rows = (
        vectors.where(_valid(F.col(embedding)) & F.col(vec_id).isNotNull())
        .select(
            F.col(vec_id).cast("long").alias("id"),
            whole_components(F.col(embedding), scale).alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("ask"),
        )
        .groupBy("id", "v")
        .agg(F.max("ask").alias("ask"))
    )
    rows = materialize(rows)
    counted = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    shards = max(1, -(-(counted.agg(F.max("n")).first()[0] or 0) // shard_rows))
    placed = rows.select(
        "id", "v", "ask", F.size("v").alias("dim"),
        F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"),
    )

    def at_home(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part["ask"]].assign(known=LEAST)
        return _found(_tree(part), own, k, query_rows) if len(own) else pd.DataFrame([], columns=["query_id", "vec_id", "score"])

    home = materialize(placed.groupBy("dim", "shard").applyInPandas(at_home, OUT))
    kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    if shards > 1:
        travelling = placed.where("ask").join(kth.withColumnRenamed("query_id", "id"), "id", "left").select(
            "id", "v", "dim", F.col("shard").alias("home"), "ask",
            F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(LEAST)).alias("known"),
        )
        everywhere = travelling.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(
            "shard <> home"
        )
        columns = ["dim", "shard", "ask", "id", "v", "known"]
        held = placed.select("dim", "shard", F.lit(False).alias("ask"), "id", "v", F.lit(LEAST).alias("known"))
        # False sorts first: the rows of a shard stand before its queries.
        streams = (
            held.unionByName(everywhere.select(*columns))
            .repartition(min(MOST_PARTS, 3 * shards), "dim", "shard")
            .sortWithinPartitions("dim", "shard", "ask")
        )

        def away(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            here, parts, tree = None, [], None
            for batch in batches:
                for (dim, shard, ask), part in batch.groupby(["dim", "shard", "ask"]):
                    if here != (dim, shard):
                        here, parts, tree = (dim, shard), [], None
                    if not ask:
                        parts.append(part)
                    elif parts:
                        tree = tree or _tree(pd.concat(parts))
                        yield _found(tree, part, k, query_rows)

        home = home.unionByName(streams.mapInPandas(away, OUT))
    # At most k rows of a query come from each shard; the aggregate keeps them apart from all others.
    best = home.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best")
    )
    return best.select("query_id", F.posexplode("best")).select(
        "query_id",
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("col.vec_id").alias("vec_id"),
        (-F.col("col.s")).alias("score"),
    )
