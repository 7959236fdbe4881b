"""Best-fit packing planned by the configuration linear program over the length histogram.

A document longer than a sequence is cut into full pieces and a shorter last one; nothing
else is cut. The pieces are counted by exact length, and the configuration linear
program (how often is each combination of lengths used, so that every length is covered by as
few sequences as possible) is solved by multiplicative weights: every length has a price, its
share of a sequence times a weight. A knapsack by dynamic programming finds the dearest
combinations, for every length the dearest one that holds it; those within ``SLACK`` of
the best one are used until a length has got its quota of the turn, and the weight of a length falls
with what it got. Prices divided by the worth of the dearest combination are feasible for the
dual program, so each turn proves a lower bound on any plan.

The uses are rounded, most used combinations first, as far as pieces are left. What
rounding leaves is packed best-fit by decreasing length into the free space of these sequences and
into new ones, whole runs of equal sequences at a time.

The driver sees at most one count a length and the plan made from it, which doesn't grow with the
documents. Pieces are ranked by length and bucket, so a length that a third of all pieces
share spreads over all buckets, and a task finds sequence and offset of a piece from its rank.

Defined results: a null or empty text holds the end id alone; very long texts are cut like any
other; repeated rows are packed each on its own; pieces of equal length take places in
the order of their rows; a null id stays null; an empty table gives no piece; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.stock_packing import cut
from tidewatch.session import materialize

CAPACITY = 2_048
END_ID = 0
TURNS = 60
STEP = 0.05  # how fast the weight of a length falls with what it got
QUOTA = 0.5  # share of its demand a length may get in one turn
SLACK = 0.01  # combinations this close to the dearest are used
BUCKET_ROWS = 50_000
RANK_BITS = 40  # ranks of a length stay below 2^40

PLACED = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
)
Contents = tuple[tuple[int, int], ...]  # (length, pieces of it), longest first


def knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest value that fits into every space up to ``room``, and the last piece taken there (0: none)."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    worth_of = np.full(room + 1, -np.inf)
    worth_of[size] = value
    for space in range(1, room + 1):
        worth = best[:space][::-1] + worth_of[1 : space + 1]  # by length of the last piece
        piece = int(worth.argmax()) + 1
        best[space] = best[space - 1]
        if worth[piece - 1] > best[space] + 1e-12:
            best[space], last[space] = worth[piece - 1], piece
    return best, last


def configurations(
    size: np.ndarray, demand: np.ndarray, room: int, turns: int = TURNS, step: float = STEP
) -> tuple[dict[Contents, float], float]:
    """Uses of each combination, near the optimum of the linear program, and a lower bound on any plan."""
    place = np.zeros(room + 1, np.int64)
    place[size] = np.arange(len(size))
    # Slightly uneven weights at first: equal ones leave the choice among full sequences to the order of lengths.
    weight = np.exp(np.random.default_rng(0).uniform(-step, step, len(size)) / 10)
    covered = np.zeros(len(size))
    uses: dict[Contents, float] = {}
    bound = 0.0
    for _ in range(turns):
        wanted = covered < 1 - 1e-9
        if not wanted.any():
            break
        price = size / room * weight
        best, last = knapsack(price[wanted], size[wanted], room)
        if wanted.all():
            bound = max(bound, float((price * demand).sum() / best[room]))
        worth = price + best[room - size]
        near = np.flatnonzero(wanted & (worth >= (1 - SLACK) * best[room]))
        got = np.zeros(len(size))
        for first in near[np.argsort(covered[near], kind="stable")]:
            if got[first] >= QUOTA - 1e-9:
                continue
            held = {int(size[first]): 1}
            space = room - int(size[first])
            while space > 0:
                piece = int(last[space])
                if piece:
                    held[piece] = held.get(piece, 0) + 1
                space -= piece or 1
            one = place[list(held)]
            many = np.array(list(held.values()))
            times = float((np.minimum(QUOTA - got[one], 1 - covered[one]) * demand[one] / many).min())
            if times <= 1e-9:
                continue
            key = tuple(sorted(held.items(), reverse=True))
            uses[key] = uses.get(key, 0.0) + times
            got[one] += times * many / demand[one]
            covered[one] += times * many / demand[one]
        if not got.any():
            break
        weight *= np.exp(-step * got)
    return uses, bound


def rounded(uses: dict[Contents, float], left: dict[int, int]) -> list[tuple[Contents, int]]:
    """Whole uses, most used combinations first; takes their pieces out of ``left``."""
    plan = []
    for contents, times in sorted(uses.items(), key=lambda u: (-u[1], u[0])):
        n = min(round(times), *(left[length] // many for length, many in contents))
        if n > 0:
            plan.append((contents, n))
            for length, many in contents:
                left[length] -= n * many
    return plan


def best_fit(plan: list[tuple[Contents, int]], left: dict[int, int], room: int) -> list[tuple[Contents, int]]:
    """Adds the pieces left, longest first, each where the least space remains."""
    runs: list[list[tuple[Contents, int]]] = [[] for _ in range(room + 1)]  # by free space
    free = np.zeros(room + 1, bool)

    def put(contents: Contents, times: int) -> None:
        space = room - sum(length * many for length, many in contents)
        runs[space].append((contents, times))
        free[space] = True

    for contents, times in plan:
        put(contents, times)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            space = length + int(free[length:].argmax())
            found = bool(free[space])
            contents, times = runs[space].pop() if found else ((), n)
            space = space if found else room
            free[space] = bool(runs[space])
            fit = space // length
            many, used = (fit, min(times, n // fit)) if n >= fit else (n, 1)
            held = dict(contents)
            held[length] = held.get(length, 0) + many
            put(tuple(sorted(held.items(), reverse=True)), used)
            if found and times > used:
                put(contents, times - used)
            n -= many * used
    return [run for some in runs for run in some]


def packing_plan(histogram: dict[int, int], room: int = CAPACITY) -> tuple[list[tuple[Contents, int]], float]:
    """Combinations of lengths and their uses, holding each piece once; and the bound that was proved."""
    left = {length: n for length, n in sorted(histogram.items()) if length < room and n}
    full = histogram.get(room, 0)
    plan, bound = [], 0.0
    if left:
        size, demand = np.array(list(left)), np.array(list(left.values()))
        uses, bound = configurations(size, demand, room)
        plan = best_fit(rounded(uses, left), left, room)
    return ([(((room, 1),), full)] if full else []) + plan, full + bound


class Slots:
    """Sequence and offset of a piece, from its length and its rank among the pieces of this length."""

    def __init__(self, plan: list[tuple[Contents, int]]) -> None:
        rows, taken, sequence = [], {}, 0
        for contents, times in plan:
            offset = 0
            for length, many in contents:
                rank = taken.get(length, 0)
                rows.append(((length << RANK_BITS) + rank, many, sequence, offset))
                taken[length] = rank + many * times
                offset += length * many
            sequence += times
        self.key, self.many, self.sequence, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << RANK_BITS) + rank
        slot = np.searchsorted(self.key, key, side="right") - 1
        inside, many = key - self.key[slot], self.many[slot]
        return self.sequence[slot] + inside // many, self.offset[slot] + inside % many * length


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: document, number, start, length and checksum."""
    whole = cut(docs, tokenizer, capacity, end_id)
    start = F.col("piece").cast("long") * capacity
    return whole.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("piece", "ids_crc32")).select(
        "doc_id",
        "piece",
        start.alias("start"),
        F.least(F.col("doc_tokens") - start, F.lit(capacity)).alias("length"),
        "ids_crc32",
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece with its sequence and offset there. ``docs`` holds ``doc_id`` and ``text``."""
    # Written once, so that row numbers of the next step stay the same when a task runs again.
    found = materialize(pieces(docs, tokenizer, capacity, end_id))
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = Slots(packing_plan(histogram, capacity)[0])
    buckets = 1 + sum(histogram.values()) // BUCKET_ROWS
    numbered = found.withColumn("_row", F.monotonically_increasing_id())
    dealt = numbered.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    inside = Window.partitionBy("length", "_bucket").orderBy("_row")
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    bases = sizes.select("length", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    ranked = dealt.select("*", F.row_number().over(inside).alias("_place")).join(bases, ["length", "_bucket"])
    rank = (F.col("_place") - 1 + F.col("_base")).alias("rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, order = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = slots.find(length, order)
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", rank).mapInArrow(place, PLACED)
