"""Packing documents into sequences as a cutting-stock problem solved by column generation.

A document is cut into full sequences and one rest. The rests are counted by length class
(``WIDTH`` tokens wide); a linear program chooses how often each pattern of classes is
used, and a knapsack by dynamic programming prices the next pattern until none can
shorten the plan. Rounded-down patterns are filled by the rests in order of their rank in
their class; what rounding leaves over is a bounded number of rests per class, packed first-fit
by decreasing length.

Only the histogram (at most ``CAPACITY / WIDTH`` counts) is planned on the driver.
Ranks come from counts per class and bucket, so a length that a third of all
documents share spreads over all buckets.

Defined results: a null text counts as empty and holds the end id alone; repeated
rows are packed each on its own; very long texts are cut into full sequences and one rest; ties in rank are ordered by id and checksum; an empty
table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks
from tidewatch.llm.words import word_ids
from tidewatch.session import materialize

CAPACITY = 2_048
WIDTH = 8
END_ID = 1
GAP = 1e-3  # the linear program may stop this close to its proven bound
TURNS = 40  # simplex steps a class at most; any plan is filled up to meet the demand
BUCKET_ROWS = 50_000

CUT = "doc_id long, doc_tokens long, crcs array<long>"
PLACED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long"
)


def best_pattern(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern of classes that fits."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    worth_of, class_of = np.full(room + 1, -np.inf), np.full(room + 1, -1)
    worth_of[size], class_of[size] = value, np.arange(len(size))
    for space in range(1, room + 1):
        worth = best[space - 1 :: -1] + worth_of[1 : space + 1]  # by length of the last piece
        length = int(worth.argmax())
        best[space] = best[space - 1]
        if worth[length] > best[space] + 1e-12:
            best[space], taken[space] = worth[length], class_of[length + 1]
    pattern, space = np.zeros(len(size), np.int64), room
    while space > 0:
        if taken[space] < 0:
            space -= 1
        else:
            pattern[taken[space]] += 1
            space -= size[taken[space]]
    return float(best[room]), pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Matrix by vector on the calling thread alone: the driver shares its cores with the JVM."""
    return (matrix * vector).sum(axis=1)


def cutting_plan(size: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, meeting the demand of every class exactly."""
    if not len(size):
        return []
    patterns = np.diag(room // size).astype(float)  # one column a pattern
    inverse = np.diag(1 / np.diag(patterns))
    # Slightly uneven demands keep the simplex steps from standing still; rounding takes them out again.
    wanted = demand + np.random.default_rng(0).uniform(0.01, 0.1, len(size))
    for turn in range(1, TURNS * len(size)):
        used = _times(inverse, wanted)
        price = inverse.sum(axis=0)
        worth, pattern = best_pattern(price, size, room)
        # Scaled by the best pattern's worth the prices are feasible: a bound on any plan.
        if worth <= 1 + 1e-9 or (price * wanted).sum() / worth >= (1 - gap) * used.sum():
            break
        step = _times(inverse, pattern)
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(np.argmin(ratio))
        patterns[:, leaves] = pattern
        row = inverse[leaves] / step[leaves]
        inverse -= np.outer(step, row)
        inverse[leaves] = row
        if turn % 256 == 0 and np.abs(_times(patterns, _times(inverse, wanted)) - wanted).max() > 1e-6 * wanted.max():
            break  # rounding errors have piled up; what the plan misses is packed below
    used = np.floor(np.maximum(_times(inverse, demand), 0) + 1e-7).astype(np.int64)
    plan, left = [], demand.astype(np.int64).copy()
    for p in np.flatnonzero(used > 0):
        pattern = np.rint(patterns[:, p]).astype(np.int64)
        fits = left[pattern > 0] // pattern[pattern > 0]
        times = int(min(used[p], fits.min()))
        if times:
            plan.append((pattern, times))
            left -= times * pattern
    return plan + first_fit(size, left, room)


def first_fit(size: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """First-fit by decreasing length, whole runs of a class at a time."""
    bins: list[list] = []  # pattern, free space
    for item in np.argsort(-size, kind="stable"):
        n = int(left[item])
        for one in bins:
            if not n:
                break
            take = min(n, one[1] // int(size[item]))
            one[0][item] += take
            one[1] -= take * int(size[item])
            n -= take
        while n:
            take = min(n, room // int(size[item]))
            pattern = np.zeros(len(size), np.int64)
            pattern[item] = take
            bins.append([pattern, room - take * int(size[item])])
            n -= take
    return [(pattern, 1) for pattern, _ in bins]


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokens of every document and the CRC-32 of each of its pieces."""
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in chunks(batches):
            tokens, crcs = [], []
            for text in batch.column(1).to_pylist():
                data = words.ids(text or "") + end
                tokens.append(len(data) // 4)
                crcs.append([zlib.crc32(data[i : i + 4 * capacity]) for i in range(0, len(data), 4 * capacity)])
            columns = [batch.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_tokens", "crcs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CUT)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: document, place in it, checksum, sequence and offset there."""
    pieces = materialize(cut(docs, tokenizer, capacity, end_id))
    rest = F.col("doc_tokens") % capacity
    kind = F.ceil(rest / width).cast("int")
    pieces = pieces.select("*", kind.alias("kind"), F.expr(f"doc_tokens div {capacity}").alias("full"))
    histogram = {r.kind: r.n for r in pieces.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    kinds = np.array(sorted(k for k in histogram if k > 0), dtype=np.int64)
    demand = np.array([histogram[k] for k in kinds], dtype=np.int64)
    plan = cutting_plan(kinds, demand, capacity // width)
    slots = slot_tables(kinds, plan)
    packed = sum(times for _, times in plan)

    buckets = 1 + sum(histogram.values()) // BUCKET_ROWS
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(buckets)))
    inside = Window.partitionBy("kind", "bucket").orderBy("doc_id", "crcs")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.select(
        "*",
        (F.row_number().over(inside) - 1).alias("rank"),
        F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full_before"),
    )
    counts = dealt.groupBy("kind", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("f"))
    earlier = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    kind_sums = counts.groupBy("kind").agg(F.sum("f").alias("f"))  # one row a class
    lower = Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
    kind_base = kind_sums.select("kind", F.coalesce(F.sum("f").over(lower), F.lit(0)).alias("kind_base"))
    offsets = counts.select(
        "kind",
        "bucket",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_base"),
        F.coalesce(F.sum("f").over(earlier), F.lit(0)).alias("full_base"),
    ).join(F.broadcast(kind_base), "kind")  # at most capacity / width + 1 rows
    numbered = ranked.join(offsets, ["kind", "bucket"]).select(
        "doc_id", "doc_tokens", "crcs", "kind",
        (F.col("rank") + F.col("rank_base")).alias("rank"),
        (F.col("full_before") + F.col("full_base") + F.col("kind_base") + packed).alias("first_full"),
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield place_pieces(part, slots, capacity)

    placed = numbered.mapInPandas(place, PLACED)
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"),
    )


def slot_tables(kinds: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first rank, pieces a sequence, first sequence and place for every pattern that holds it."""
    first = np.cumsum([0, *(times for _, times in plan)])
    tables = {}
    for i, kind in enumerate(kinds.tolist()):
        held = [(p, int(pattern[i]), times) for p, (pattern, times) in enumerate(plan) if pattern[i]]
        many = np.array([a for _, a, _ in held], np.int64)
        ranks = np.cumsum([0, *(a * t for _, a, t in held)])[:-1]
        places = np.array([plan[p][0][:i].sum() for p, _, _ in held], np.int64)
        tables[kind] = ranks.astype(np.int64), many, first[[p for p, _, _ in held]].astype(np.int64), places
    return tables


def place_pieces(part: pd.DataFrame, slots: dict, capacity: int) -> pd.DataFrame:
    tokens, kind, rank = (part[c].to_numpy(np.int64) for c in ("doc_tokens", "kind", "rank"))
    full = tokens // capacity
    sequence, where = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    for k in np.unique(kind[kind > 0]).tolist():
        rows = np.flatnonzero(kind == k)
        ranks, many, first, places = slots[k]
        p = np.searchsorted(ranks, rank[rows], side="right") - 1
        inside = rank[rows] - ranks[p]
        sequence[rows] = first[p] + inside // many[p]
        where[rows] = places[p] + inside % many[p]
    n = np.array([len(c) for c in part["crcs"]], np.int64)
    row = np.repeat(np.arange(len(part)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    rest = nth >= full[row]
    crcs = np.concatenate([np.asarray(c, np.int64) for c in part["crcs"]]) if len(part) else np.empty(0, np.int64)
    return pd.DataFrame(
        {
            "doc_id": part["doc_id"].astype("Int64").iloc[row].to_numpy(dtype=object, na_value=None),
            "start": nth * capacity,
            "length": np.where(rest, tokens[row] % capacity, capacity),
            "ids_crc32": crcs,
            "doc_tokens": tokens[row],
            "sequence_id": np.where(rest, sequence[row], part["first_full"].to_numpy(np.int64)[row] + nth),
            "place": np.where(rest, where[row], 0),
        }
    )
