"""Exact n-gram Jaccard join of texts, as connected components.

A text is its set of distinct word shingles; texts of equal sets form a class and
take part once. Two classes link when the Jaccard distance of their sets is at most
``eps = 1 - PERCENT/100``.

Regions. The pivots of the first level are the one-word sets {s}: a text containing s
is nearer to {s} than any text without it, and of the pivots equally near the first in
a global order of shingles counts, rare shingles before common ones. By the triangle
inequality a partner within eps can only lie in regions of the first
``n - ceil(n * PERCENT / 100) + 1`` pivots of a text, its window, so the text is copied to
these: linked texts meet in the region of their first common shingle. Any order is
exact; a table of fixed size that says how common shingles are only keeps regions small.

Small regions hand out their pairs, of which only those stay whose windows leave a
link possible. The texts of larger regions are copied once more, now in an order that
puts the pivots of these regions last. What is still large then is filled by near copies.
Pairs and large regions that overlap are merged.

Recursion. A merged region takes texts of its own as pivots. Each text x lies at home in the
Voronoi cell of its nearest pivot and is a guest in the cell of pivot q where
d(x, q) - min d(x, p) <= 2 eps: for linked x and y, y at home with p, the triangle inequality gives
d(x, p) <= d(y, p) + eps <= d(y, q) + eps <= d(x, q) + 2 eps for every q, so x is in y's cell.
The argument needs no more than that linked texts differ by eps at most in each d(., p), which a constant
meets too: a further cell stands at the distance FAR and takes the texts far from all pivots. Cells are cut
again with new pivots while this lowers the sum of the squares of what they hold; what it doesn't
lower are near copies of each other. Regions above a block are cut so by Spark, blocks inside
their tasks; a cell above a block that can't be cut goes in pairs of blocks. Texts within eps of a
pivot are linked to it, and a cell tests no pairs within the largest component known to it. Links that
join nothing new are not written, so no pairs of a group of near copies are.

Shingles are compared by 64-bit hashes, sets by 128-bit digests of these.

Defined results: null or a text without words has an empty set, links to nothing and
is its own component; with fewer words than a shingle the whole sequence is one; a null
id takes part, and a component's id is the smallest id that is not null; repeated rows
each keep their row; an empty table gives an empty result; other columns pass through
``keep_one`` untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, free_name
from tidewatch.session import materialize

WORDS = 4
PERCENT = 85
LEVELS = 1 << 22  # entries of the tables of common shingles and of wanted ids, 4 MB: they only affect speed
CROWDED = 128  # level from which a shingle is known to crowd a region
COUNT_SHINGLES = 1 << 21  # shingles a task counts at a time: 8 MB
SMALL = 16  # texts of a region that are paired directly
PIVOTS = 16  # texts that a region takes as pivots at most
FAR = 0.5  # distance at which the cell of texts far from all pivots stands
WORTH = 0.75  # cells are kept where the squares of what they hold sum to this share of the whole's
BLOCK_SHINGLES = 1 << 20  # shingles of a block of texts: 8 MB

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_hash = xxhash.xxh3_64_intdigest


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C[1]
    h = (h ^ (h >> np.uint64(27))) * _C[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes. bytes.lower() and bytes.split() know ASCII alone."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_hash, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    out = h[: len(h) - width + 1] + np.uint64(width)
    for i in range(1, width):
        out = _mix(out) + h[i : len(h) - width + 1 + i]
    return np.unique(_mix(out).view(np.int64))


def digest(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def window_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def folded(found: np.ndarray) -> np.ndarray:
    """Shingles as 32-bit numbers: texts that share a shingle share its number."""
    return found.view(np.uint64).astype(np.uint32).view(np.int32)


def common_levels(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """How common shingles are, by entry of the table. Tasks count blocks of whole sets, copies once, and pass on what repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def count() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate([*held.values(), np.empty(0, np.int32)]), return_counts=True)
            again = n > 1
            return pa.RecordBatch.from_arrays([pa.array(values[again]), pa.array(n[again].astype(np.int64))], ["s", "n"])

        for batch in chunks(batches):
            for text in batch.column(0).to_pylist():
                found = shingles(text, words)
                key = digest(found)
                if key and key not in held:
                    held[key] = np.unique(folded(found))
                    size += len(found)
                if size >= COUNT_SHINGLES:
                    yield count()
                    held.clear()
                    size = 0
        yield count()

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "s int, n long")
    return raised(np.zeros(LEVELS, np.uint8), counted, 0)


def raised(levels: np.ndarray, counted: DataFrame, least: int) -> np.ndarray:
    """The table with the entries of counted shingles (s, n) set to ``least`` plus a logarithm of n.

    Tasks pack the entries into blocks of bytes, so LEVELS bytes reach the driver at most.
    """
    entry = F.col("s").bitwiseAND(LEVELS - 1).cast("int").alias("entry")
    height = F.least(F.lit(127.0), 4 * F.log2(F.sum("n") + 1)).cast("int").alias("height")
    blocked = counted.groupBy(entry).agg(height).withColumn("block", F.shiftright("entry", 12)).repartition("block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            entries, heights, owner = (batch.column(i).to_numpy() for i in range(3))
            for block in np.unique(owner).tolist():
                own = owner == block
                held = blocks.setdefault(block, np.zeros(4096, np.uint8))
                held[entries[own] & 4095] = heights[own]
        data = pa.array([x.tobytes() for x in blocks.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), data], ["block", "data"])

    levels = levels.copy()
    for row in blocked.mapInArrow(pack, "block int, data binary").collect():
        held = np.frombuffer(row.data, np.uint8)
        at = np.flatnonzero(held)
        levels[(row.block << 12) + at] = least + held[at]
    return levels


class Order:
    """The global order of pivots: shingles by the level of their entry, rare ones first, then by hash."""

    def __init__(self, levels: np.ndarray) -> None:
        self.levels = levels

    def first(self, found: np.ndarray, length: int) -> np.ndarray:
        """The first shingles of a sorted set."""
        level = self.levels[folded(found) & np.int32(LEVELS - 1)]
        return found[np.argsort(level, kind="stable")[:length]]

    def window(self, found: np.ndarray, percent: int) -> np.ndarray:
        """The window of a set, folded."""
        return np.unique(folded(self.first(found, window_length(len(found), percent))))


def signed(docs: DataFrame, levels: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: id, digest of its text, set size, digest of its set, window."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # LEVELS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(shared.value)
        for batch in chunks(batches):
            keys, sizes, digests, windows = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                keys.append(None if text is None else hashlib.md5(text.encode()).digest())
                sizes.append(len(found))
                digests.append(digest(found))
                windows.append(order.window(found, percent))
            columns = [
                batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                pa.array(windows, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "digest", "window"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, text_key binary, n long, digest binary, window array<int>")


def regions(classes: DataFrame, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """Copies every class to the regions of its window. Small regions give pairs (a < b), larger ones members (a of b).

    Rows of a region stand together in sorted order; a region is known to be large as
    soon as it shows ``small`` + 1 rows, so no task holds one in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in range(3)]  # rows of a region that may go on
        large = None  # the region that is known to be large and may go on

        def work(s: np.ndarray, c: np.ndarray, n: np.ndarray, going_on: bool) -> pa.RecordBatch:
            nonlocal large
            start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
            size = np.diff(np.r_[start, len(s)])
            wide = size > small
            if len(s) and large is not None and s[0] == large:
                wide[0] = True
            per_row = np.repeat(wide, size)
            out = [(c[per_row], s[per_row], np.ones(int(per_row.sum()), bool))]
            s2, c2, n2 = s[~per_row], c[~per_row], n[~per_row]
            for d in range(1, small):
                i = np.flatnonzero(s2[d:] == s2[:-d]) if len(s2) > d else np.empty(0, np.int64)
                near = 100 * np.minimum(n2[i], n2[i + d]) >= percent * np.maximum(n2[i], n2[i + d])
                i = i[near]
                out.append((c2[i], c2[i + d], np.zeros(len(i), bool)))
            if len(s):
                large = s[-1] if wide[-1] else None
            a, b, member = (np.concatenate(x) for x in zip(*out))
            low, high = np.where(member, a, np.minimum(a, b)), np.where(member, b, np.maximum(a, b))
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(member)], ["a", "b", "member"])

        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(3)]
            s, c, n = (np.concatenate([h, x]) for h, x in zip(held, new))
            if not len(s):
                continue
            cut = int(np.searchsorted(s, s[-1]))
            if len(s) - cut > small or large is not None and s[-1] == large:
                cut = len(s)  # large already: nothing to hold back
            held = [x[cut:] for x in (s, c, n)]
            yield work(s[:cut], c[:cut], n[:cut], True)
        yield work(*held, False)

    copied = classes.select(F.explode("window").alias("s"), "cid", "n")
    sorted_rows = copied.repartition("s").sortWithinPartitions("s", "cid")
    return sorted_rows.mapInArrow(run, "a long, b long, member boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) that isn't the smallest of its component.

    Each task first reduces its edges to a forest; then nodes that several forests
    know tie their roots together, and paths are halved, until nothing changes.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                trees.join(a, b)
        pairs = [(x, trees.root(x)) for x in list(trees.parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        node, top = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(top, pa.int64())], ["node", "root"])

    links = materialize(edges.select("a", "b").repartition("a").mapInArrow(forest, "node long, root long"))
    while True:
        best = links.groupBy("node").agg(F.min("root").alias("best"))
        above = best.select(F.col("node").alias("best"), F.col("best").alias("top"))
        hopped = best.join(above, "best", "left").select(
            "node", F.coalesce("top", "best").alias("root"), F.col("top").isNotNull().alias("moved")
        )
        tied = links.join(best, "node").where("root <> best").select(
            F.col("root").alias("node"), F.col("best").alias("root"), F.lit(True).alias("moved")
        )
        step = materialize(hopped.unionByName(tied).groupBy("node", "root").agg(F.max("moved").alias("moved")))
        links = step.select("node", "root")
        if step.where("moved").isEmpty():
            return links


def _again(
    docs: DataFrame, wanted: DataFrame, prepare: Callable[[], Callable[[np.ndarray], np.ndarray]], out: str, kind: str, words: int
) -> DataFrame:
    """(cid, out) of the wanted classes (cid, first, digest): what ``prepare()`` makes of the shingles of a text of each.

    A bit map over the hashes of the wanted ids, of fixed size, lets a task skip most
    other texts; the join on the digest is what decides.
    """
    bucket = lambda c: F.xxhash64(c).bitwiseAND(LEVELS - 1).cast("int")
    asked = wanted.select(bucket(F.col("first")).alias("s"), F.lit(1).alias("n"))
    bits = raised(np.zeros(LEVELS, np.uint8), asked, 0) > 0
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bits, work = np.unpackbits(packed.value).view(bool), prepare()
        numbers = pa.list_(pa.int64() if kind == "long" else pa.int32())
        for batch in batches:
            batch = batch.filter(pa.array(open_bits[batch.column(0).to_numpy()]))
            for part in chunks(iter([batch])):
                found = [shingles(t, words) for t in part.column(1).to_pylist()]
                columns = [pa.array([digest(x) for x in found], pa.binary()), pa.array([work(x) for x in found], numbers)]
                yield pa.RecordBatch.from_arrays(columns, ["digest", out])

    texts = docs.select(bucket(F.col("doc_id").cast("long")).alias("bit"), F.col("text").cast("string"))
    found = texts.mapInArrow(run, f"digest binary, {out} array<{kind}>")
    once = found.groupBy("digest").agg(F.any_value(out).alias(out))
    return wanted.select("cid", "digest").join(once, "digest").select("cid", out)


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link as far as their windows tell.

    Of the window that ends first, in the global order, every shared shingle is in both
    windows; all other shared shingles lie beyond it.
    """
    inside = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "cid")
    needed = classes.select("cid", "n", "window").join(inside, "cid", "left_semi")
    left = needed.select(F.col("cid").alias("a"), F.col("n").alias("n"), F.col("window").alias("x"))
    right = needed.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("window").alias("y"))
    met = pairs.join(left, "a").join(right, "b").select(
        "a", "b", "n", "m", F.size(F.array_intersect("x", "y")).alias("i"),
        F.greatest(F.col("n") - F.size("x"), F.col("m") - F.size("y")).alias("beyond"),
    )
    return met.where(F.expr(f"100 * (i + beyond) >= {percent} * (n + m - i - beyond)")).select("a", "b")


class Forest:
    """Union-find over numbers."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


class Held:
    """Sets of some texts (rows of a task) and where each shingle occurs, in order of shingles."""

    def __init__(self, rows: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, values: np.ndarray, owner: np.ndarray) -> None:
        self.rows, self.sets, self.sizes, self.values, self.owner = rows, sets, sizes, values, owner

    @classmethod
    def of(cls, part: pd.DataFrame) -> Held:
        sets = [np.asarray(s, np.int64) for s in part["set"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(values, kind="stable")
        return cls(np.arange(len(sets)), sets, sizes, values[order], owner[order])

    def common(self, at: int) -> np.ndarray:
        """Size of the intersection with every text, by the places of the shingles of one."""
        lo, hi = (np.searchsorted(self.values, self.sets[at], side) for side in ("left", "right"))
        n = hi - lo
        places = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[places], minlength=len(self.sets))

    def linked(self, at: int, percent: int, common: np.ndarray | None = None) -> np.ndarray:
        """Texts within eps of one, itself included."""
        common = self.common(at) if common is None else common
        return np.flatnonzero(100 * common >= percent * (self.sizes + self.sizes[at] - common))

    def only(self, inside: np.ndarray) -> Held:
        kept = inside[self.owner]
        renumbered = np.cumsum(inside) - 1
        sets = [self.sets[i] for i in np.flatnonzero(inside)]
        return Held(self.rows[inside], sets, self.sizes[inside], self.values[kept], renumbered[self.owner[kept]])


def cells_of(
    held: Held, ids: np.ndarray, home: np.ndarray, percent: int, near: Callable[[Held, int, np.ndarray], None]
) -> Iterator[tuple[Held, np.ndarray]]:
    """Voronoi cells of a task's texts, and which texts are at home in them.

    Some texts are pivots, further than FAR from each other; ``near`` is told who lies within eps of each. Texts of a cell are cut again while
    that lowers the sum of the squares of what the cells hold to ``WORTH`` of the whole.
    """
    waiting = [(held, home, 0)]
    while waiting:
        held, home, level = waiting.pop()
        m = len(held.rows)
        if m <= SMALL:
            yield held, home
            continue
        number = ids[held.rows].view(np.uint64) + np.uint64(level)
        gaps = np.full((1, m), FAR, np.float32)
        for at in np.argsort(_mix(number * _C[0]), kind="stable")[: min(PIVOTS, math.isqrt(m))].tolist():
            if len(gaps) > 1 and gaps[1:, at].min() <= FAR:
                continue  # an earlier pivot stands for it
            common = held.common(at)
            near(held, at, held.linked(at, percent, common))
            gap = 1 - common / (held.sizes + held.sizes[at] - common)
            gaps = np.concatenate([gaps, gap[None].astype(np.float32)])
        nearest = gaps.argmin(0)
        inside = gaps <= gaps.min(0) + reach(percent)
        weight = held.sizes.astype(float)
        inside &= np.array([(nearest == i).any() for i in range(len(gaps))])[:, None]
        if ((inside @ weight) ** 2).sum() > WORTH * weight.sum() ** 2:
            yield held, home
            continue
        for i in np.flatnonzero(inside.any(1)).tolist():
            waiting.append((held.only(inside[i]), (home & (nearest == i))[inside[i]], level + 1))


def region_links(part: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that join the texts of one or two blocks of a region (columns cid, block, set), cell by cell.

    Texts within eps of a pivot are linked to it. In a cell the largest component that is known needs no
    test within itself; all other texts are held against all texts of the cell. With two blocks these are
    links across them.
    """
    ids, blocks = part["cid"].to_numpy(), part["block"].to_numpy()
    across = blocks.min() != blocks.max()
    forest, links = Forest(), []

    def near(held: Held, at: int, others: np.ndarray) -> None:
        one = int(ids[held.rows[at]])
        for other in ids[held.rows[others]].tolist():
            if forest.join(one, other):
                links.append((one, other))

    for held, _ in cells_of(Held.of(part), ids, np.ones(len(ids), bool), percent, near):
        roots = np.array([forest.root(i) for i in ids[held.rows].tolist()])
        found, n = np.unique(roots, return_counts=True)
        for at in np.flatnonzero(roots != found[n.argmax()]).tolist():
            others = held.linked(at, percent)
            if across:
                others = others[blocks[held.rows[others]] != blocks[held.rows[at]]]
            near(held, at, others)
    return links


def reach(percent: int) -> float:
    """Twice eps, and a little more for rounding: that only copies more."""
    return 2 * (1 - percent / 100) + 1e-6


def _regions_of(pairs: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs and large regions (a of region b) merged where they overlap: g, cid, n."""
    pivot = members.groupBy("b").agg(F.min("a").alias("low"))
    overlaps = members.join(pivot, "b").where("a <> low").select("a", F.col("low").alias("b")).distinct()
    merged = materialize(components(pairs.unionByName(overlaps)))
    texts = merged.select(F.col("node").alias("cid"), F.col("root").alias("g")).unionByName(
        merged.select(F.col("root").alias("cid"), F.col("root").alias("g")).distinct()
    )
    return materialize(texts.join(classes.select("cid", "n"), "cid").select(F.col("g").cast("string").alias("g"), "cid", "n"))


def cut_once(wide: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Texts of regions (g, cid, n, home, parts) in the cells of pivots drawn from the region: whole, and g, cid, n, home of the cell.

    Pivots are further than FAR from each other. A pivot holds at most a share of a block, so the pivots of a region fit in one row. Regions
    stand in ``parts`` parts, each with its own copy of that row.
    """
    part = lambda c: F.pmod(F.xxhash64(F.lit(2), c), F.col("parts"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("g", "cid"), "cid"))
    drawn = wide.where(F.col("n") <= BLOCK_SHINGLES // PIVOTS).select("g", "cid", "parts", rank.alias("k")).where(F.col("k") <= PIVOTS)
    common = lambda p, q: F.size(F.array_intersect(p["set"], q["set"]))
    close = lambda p, q: common(p, q) >= (1 - FAR) * (F.size(p["set"]) + F.size(q["set"]) - common(p, q))
    row = F.sort_array(F.collect_list(F.struct("k", "set"))).alias("drawn")
    thin = F.aggregate(
        "drawn", F.slice("drawn", 1, 1), lambda kept, p: F.when(F.exists(kept, lambda q: close(p, q)), kept).otherwise(F.concat(kept, F.array(p)))
    )
    pivots = (
        drawn.join(sets, "cid").groupBy("g", "parts").agg(row)
        .select("g", thin.alias("pivots"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    )
    met = F.transform("pivots", lambda p: F.struct(F.size(F.array_intersect("set", p["set"])).alias("i"), F.size(p["set"]).alias("m")))
    gaps = F.concat(F.transform(met, lambda x: 1 - x["i"] / (F.col("n") + x["m"] - x["i"])), F.array(F.lit(FAR)))
    # Pivots come before the far cell and in their order where gaps are equal.
    return (
        wide.withColumn("part", part("cid")).join(sets, "cid").join(pivots, ["g", "part"])
        .select("g", "cid", "n", "home", gaps.alias("gaps"))
        .select("g", "cid", "n", "home", "gaps", F.array_min("gaps").alias("least"))
        .select("g", "cid", "n", "home", "least", F.array_position("gaps", F.col("least")).alias("own"), F.posexplode("gaps"))
        .where(F.col("col") <= F.col("least") + reach(percent))
        .select(
            F.col("g").alias("whole"), F.concat_ws(".", "g", "pos").alias("g"), "cid", "n",
            (F.col("home") & (F.col("pos") + 1 == F.col("own"))).alias("home"),
        )
    )


def _cells(found: DataFrame, sets: Callable[[], DataFrame], percent: int) -> DataFrame:
    """Regions of more than a block cut into Voronoi cells, and these again while it pays: g, cid, n, home."""
    going, done = found.withColumn("home", F.lit(True)), []
    while True:
        sizes = going.groupBy("g").agg(F.sum("n").alias("size"))
        above = materialize(sizes.where(F.col("size") > BLOCK_SHINGLES).withColumn("parts", F.ceil(F.col("size") / BLOCK_SHINGLES)))
        done.append(going.join(above, "g", "left_anti"))
        if above.isEmpty():
            break
        wide = going.join(above.select("g", "parts"), "g")
        cut = materialize(cut_once(wide, sets(), percent))
        cells = cut.groupBy("whole", "g").agg(F.sum("n").cast("double").alias("held"), F.max("home").alias("lived_in")).where("lived_in")
        cost = cells.groupBy("whole").agg(F.sum(F.col("held") * F.col("held")).alias("cost"))
        paid = materialize(
            cost.join(above.withColumnRenamed("g", "whole"), "whole")
            .where(F.col("cost") <= WORTH * F.col("size") * F.col("size"))
            .select("whole")
        )
        done.append(wide.join(paid, wide["g"] == paid["whole"], "left_anti").drop("parts"))
        going = materialize(cut.join(paid, "whole").join(cells.select("g"), "g", "left_semi").select("g", "cid", "n", "home"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more.select(*whole.columns))
    return whole


def _dealt(cells: DataFrame) -> DataFrame:
    """Cells dealt to tasks (g, p, q) that see two blocks at most: a text of block k goes to the tasks (k, j) of all blocks j."""
    blocks = cells.groupBy("g").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    dealt = cells.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64(F.lit(1), "cid"), F.col("blocks")))
    tasks = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    return tasks.select("g", F.least("block", "j").alias("p"), F.greatest("block", "j").alias("q"), "cid", "block", "home")


def _region_links(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within the cells."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(region_links(part, percent), columns=["a", "b"], dtype="int64")

    return dealt.join(sets, "cid").groupBy("g", "p", "q").applyInPandas(run, "a long, b long")


def _met(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of small regions that may link, and members of large ones."""
    met = materialize(regions(classes, percent))
    pairs = met.where("not member").select("a", "b").distinct()
    return materialize(possible(pairs, classes, percent)), met.where("member").select("a", "b")


def _laid_out(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signed documents, classes, cells dealt to tasks, and the sets of their classes."""
    levels = common_levels(docs, words)
    marks = materialize(signed(docs, levels, words, percent))
    classes = materialize(
        marks.where("n > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.any_value("n").alias("n"), F.any_value("window").alias("window"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    pairs, members = _met(classes, percent)
    # The texts of large regions once more, now that the shingles which made them large are known to be common.
    crowded = materialize(classes.join(members.select(F.col("a").alias("cid")).distinct(), "cid").select("cid", "first", "digest", "n"))
    crowds = members.groupBy(F.col("b").cast("int").alias("s")).agg(F.count("*").alias("n"))
    shared = docs.sparkSession.sparkContext.broadcast(raised(levels, crowds, CROWDED))  # LEVELS bytes

    def windows() -> Callable[[np.ndarray], np.ndarray]:
        later = Order(shared.value)
        return lambda found: later.window(found, percent)

    anew = _again(docs, crowded, windows, "window", "int", words)
    more, members = _met(materialize(crowded.select("cid", "n").join(anew, "cid")), percent)
    found = _regions_of(pairs.unionByName(more), members, classes)
    wanted = classes.select("cid", "first", "digest").join(found.select("cid").distinct(), "cid")
    sets = _again(docs, wanted, lambda: lambda found: found, "set", "long", words)
    kept: list[DataFrame] = []

    def written_sets() -> DataFrame:
        if not kept:
            kept.append(materialize(sets))
        return kept[0]

    dealt = materialize(_dealt(_cells(found, written_sets, percent)))
    return marks, classes, dealt, kept[0] if kept else sets


def labelled(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Signed documents, and (digest, root, component_id) of every class."""
    marks, classes, dealt, sets = _laid_out(docs, words, percent)
    links = _region_links(dealt, sets, percent)
    roots = components(links)
    placed = classes.select("cid", "digest", "first").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    placed = materialize(placed.select("digest", "first", F.coalesce("root", "cid").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return marks, placed.join(lowest, "root").select("digest", "root", "component_id")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    marks, classes = labelled(docs, words, percent)
    return marks.join(classes, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def counted_links(part: pd.DataFrame, percent: int) -> np.ndarray:
    """For every text at home in one or two blocks (columns cid, block, home, copies, set) the copies of the texts that it links to.

    All its partners are in the cell where it is at home, so it is held against that one alone.
    With two blocks only links across them count.
    """
    ids, blocks, copies = part["cid"].to_numpy(), part["block"].to_numpy(), part["copies"].to_numpy()
    across, out = blocks.min() != blocks.max(), np.zeros(len(ids), np.int64)
    for held, home in cells_of(Held.of(part), ids, part["home"].to_numpy(bool), percent, lambda *_: None):
        for at in np.flatnonzero(home).tolist():
            others = held.rows[held.linked(at, percent)]
            row = held.rows[at]
            others = others[blocks[others] != blocks[row]] if across else others[others != row]
            out[row] = copies[others].sum()
    return out


def link_counts(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, class_id (digest of the set; null without words) and n_links, the other rows that a row links to.

    Every link of different texts is verified, so a group of k near copies costs k * k
    intersections in its tasks; what they write grows with k alone.
    """
    marks, classes, dealt, sets = _laid_out(docs, words, percent)
    copies = marks.where("n > 0").groupBy("digest").agg(F.count("*").alias("copies"))
    weighted = materialize(classes.select("cid", "digest").join(copies, "digest"))
    ready = dealt.join(weighted.select("cid", "copies"), "cid").join(sets, "cid")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cid": part["cid"], "linked": counted_links(part, percent)})

    linked = ready.groupBy("g", "p", "q").applyInPandas(run, "cid long, linked long")
    summed = weighted.join(linked.groupBy("cid").agg(F.sum("linked").alias("linked")), "cid", "left")
    counts = summed.select("digest", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return marks.join(counts, "digest", "left").select(
        "doc_id", F.lower(F.hex("digest")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of every component: the smallest id, then the smallest text digest. Texts without words all stay."""
    marks, classes = labelled(docs, words, percent)
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")
    best_id, best_key, key = (free_name(docs, c) for c in ("best_id", "best_key", "text_key"))
    chosen = (
        marks.where("n > 0").join(classes, "digest").groupBy("root").agg(F.min(place).alias("best"))
        .select(F.col("best.doc_id").alias(best_id), F.col("best.text_key").alias(best_key))
    )
    keyed = docs.withColumn(key, F.unhex(F.md5(F.col("text").cast("string"))))
    same = F.col(f"`{key}`").eqNullSafe(F.col(best_key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(best_id))
    kept = keyed.join(chosen, same, "left_semi").dropDuplicates(["doc_id", key])
    wordless = keyed.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.unionByName(wordless).select(*[F.col(f"`{c}`") for c in docs.columns])
