"""Running sums, ranks and exact quantiles that never sort a whole column in one task.

A window without a fine PARTITION BY sends all rows to one task. Everything
that needs a whole order here (rank statistics, ROC curves, batch numbers) goes through :func:`running_totals`: rows are cut into value ranges,
each range is summed on its own, and the range totals (a few thousand rows at
most) supply the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.session import materialize

MIN_SLOTS = 16
MAX_SLOTS = 4096
SMALL_BRACKET = 100_000  # so many distinct values are summed in one task; more are cut into ranges


def range_slots(spark: SparkSession) -> int:
    """Number of value ranges: a few per shuffle partition, within fixed bounds."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_SLOTS, min(MAX_SLOTS, 4 * partitions))


def running_totals(
    df: DataFrame,
    order_col: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
    slots: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``run_<m>`` and group totals ``all_<m>``.

    ``df`` holds one row per (``by``, ``order_col``): aggregate first, so a hot
    value is a single row. ``by`` may have any number of groups, each
    arbitrarily large.

    The split points are the values with the smallest hash in each of
    ``slots`` hash slots: an even sample of the distinct values that is the
    same on every evaluation, so recomputed tasks agree on the ranges. Every
    branch reads all measures to let Spark reuse one shuffle of the input.
    """
    spark = df.sparkSession
    slots = slots or range_slots(spark)
    by = list(by)
    step = max(1, int(slots**0.5))
    hashed = F.xxhash64(order_col)
    ranges = (
        df.groupBy(*by, F.pmod(hashed, F.lit(slots)).alias("_slot"))
        .agg(
            F.min_by(F.col(order_col), hashed).alias("_pick"),
            *[F.sum(m).alias(f"_sum_{m}") for m in measures],
        )
        .groupBy(*by)
        .agg(
            F.array_sort(F.collect_set("_pick")).alias("_points"),
            *[F.sum(f"_sum_{m}").alias(f"all_{m}") for m in measures],
        )
        .withColumn(
            "_heads",
            F.transform(
                F.sequence(F.lit(1), F.size("_points"), F.lit(step)),
                lambda i: F.element_at("_points", i),
            ),
        )
    )
    # A schema bounds its columns, so their split points may be broadcast; those of other
    # groups are joined by key, whichever way suits their number.
    few = not [c for c in by if c != "column"]
    if few:
        ranges = F.broadcast(ranges)  # at most `slots` values for each column
    joined = df.join(ranges, by) if by else df.join(ranges)
    value = F.col(order_col)
    head = F.size(F.filter("_heads", lambda p: p < value)).alias("_head")
    skipped = F.greatest(F.col("_head") - 1, F.lit(0)) * step
    position = skipped + F.size(F.filter(F.slice("_points", skipped + 1, F.lit(step)), lambda p: p < value))
    # A group that sums to nothing is one range. The test also keeps the totals
    # in every branch below, so that Spark reuses the shuffles.
    nonzero = sum((F.abs(F.col(f"all_{m}")) for m in measures[1:]), F.abs(F.col(f"all_{measures[0]}"))) > 0
    placed = joined.select("*", head).select(
        *df.columns,
        *[f"all_{m}" for m in measures],
        F.when(nonzero, position).otherwise(F.lit(0)).alias("_range"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(order_col)
    local = placed.select("*", *[F.sum(m).over(inside).alias(f"_local_{m}") for m in measures])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "_range")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *by,
            "_range",
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_before_{m}") for m in measures],
        )
    )
    return local.join(F.broadcast(offsets) if few else offsets, [*by, "_range"]).select(
        *df.columns,
        *[(F.col(f"_local_{m}") + F.col(f"_before_{m}")).alias(f"run_{m}") for m in measures],
        *[f"all_{m}" for m in measures],
    )


def number_rows(df: DataFrame, key: str, name: str = "row_number") -> DataFrame:
    """Exact 1-based position of each row in the order of a unique ``key``."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(counted, key, ["_one"]).select(*df.columns, F.col("run__one").alias(name))


def unpivot_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(keep…, column, value)`` of numeric columns; NaN becomes null."""
    pairs = [
        F.struct(F.lit(c).alias("column"), nan_to_null(F.col(c).cast("double")).alias("value")) for c in columns
    ]
    return df.select(*keep, F.inline(F.array(*pairs)))


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


class Selection:
    """Exact quantiles and moments of numeric columns by bracket and refine, in two scans.

    The first scan takes the moments and a mergeable sketch, whose guaranteed error gives a bracket
    around each wanted rank. The second one counts: values outside all brackets are one row
    a gap, values inside are counted one by one. Only these few are shuffled and ranked. If
    a rank falls into a gap all the same, the gap becomes a bracket and the scan is repeated.

    The driver holds one row a column and a few counts a bracket; nothing it holds grows with the rows.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 2_000) -> None:
        self.spark, self.columns = df.sparkSession, list(columns)
        self.probs = sorted({float(p) for p in probs})
        self.clean = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
        margin = 2 / accuracy  # twice the sketch's own error
        edges = [min(1.0, max(0.0, p + d)) for p in self.probs for d in (-margin, margin)]
        found = []
        for i in range(len(self.columns)):
            v = F.col(f"v{i}")
            sketch = [F.percentile_approx(v, edges, F.lit(accuracy)).alias("edges")] if edges else []
            parts = [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")]
            found.append(F.struct(*parts, F.min(v).alias("min"), F.max(v).alias("max"), *sketch).alias(f"v{i}"))
        self.stats = list(self.clean.agg(*found).first()) if found else []
        self.brackets = [self._first_brackets(s) if s["count"] and edges else [] for s in self.stats]
        self.counted = self.wanted = None
        while any(self.brackets) and self.wanted is None:
            self._count()

    def _first_brackets(self, stats) -> list[tuple[float, float]]:
        spans = []
        for j, p in enumerate(self.probs):
            low, high = stats["edges"][2 * j], stats["edges"][2 * j + 1]
            spans.append((stats["min"] if p <= 0 else low, stats["max"] if p >= 1 else high))
        return _merged(spans)

    def _count(self) -> None:
        """Counts by bracket and gap; leaves ``wanted`` empty and wider brackets if a rank fell into a gap."""
        width = 2 * len(self.probs) + 1  # gaps and brackets of a column take turns
        cells = []
        for i, spans in enumerate(self.brackets):
            v = F.col(f"v{i}")
            # Even places are gaps, odd ones brackets.
            place = sum(((v >= lo).cast("int") + (v > hi).cast("int") for lo, hi in spans), F.lit(0))
            if spans:
                cells.append(
                    F.struct(
                        (place + i * width).alias("column"), v.isNotNull().alias("_there"),
                        F.when(place % 2 == 1, v).alias("value"),
                    )
                )
        longform = self.clean.select(F.inline(F.array(*cells))).where("_there")
        self.counted = materialize(longform.groupBy("column", "value").agg(F.count("*").alias("n")))
        totals = self.counted.groupBy("column").agg(F.sum("n").alias("n"), F.count("value").alias("values")).collect()
        self.largest = max(r["values"] for r in totals)
        of_place = {r["column"]: r["n"] for r in totals}
        wanted, missed = [], False
        for i, stats in enumerate(self.stats):
            before, bounds = 0, []
            for place in range(width):
                n = of_place.get(i * width + place, 0)
                bounds.append((before, before + n))
                before += n
            for prob in self.probs if self.brackets[i] else ():
                position = prob * (stats["count"] - 1)
                for rank in {math.floor(position), math.ceil(position)}:
                    place = next(k for k, (a, b) in enumerate(bounds) if a <= rank < b)
                    if place % 2 == 0:
                        spans = self.brackets[i]
                        low = spans[place // 2 - 1][1] if place else stats["min"]
                        high = spans[place // 2][0] if place // 2 < len(spans) else stats["max"]
                        self.brackets[i] = _merged([*spans, (low, high)])
                        missed = True
                        break
                    name = self.columns[i]
                    share = position - math.floor(position)
                    wanted.append((i * width + place, name, prob, rank - bounds[place][0], share, rank == math.floor(position)))
                else:
                    continue
                break  # the places of this column have moved
        if not missed:
            self.wanted = wanted

    def moments(self) -> DataFrame:
        """``(column, count, mean, std, min, max)`` with the sample deviation; no row for a column without values."""
        rows = [(c, *s[:5]) for c, s in zip(self.columns, self.stats) if s["count"]]
        schema = "column string, count long, mean double, std double, min double, max double"
        return self.spark.createDataFrame(rows, schema)

    def quantiles(self) -> DataFrame:
        """``(column, prob, value)`` with linear interpolation; no row for a column without values."""
        if not self.wanted:
            return self.spark.createDataFrame([], "column string, prob double, value double")
        schema = "column int, name string, prob double, rank long, part double, lower boolean"
        wanted = self.spark.createDataFrame(self.wanted, schema)
        inside = self.counted.where(F.col("value").isNotNull())
        if self.largest <= SMALL_BRACKET:
            inside = inside.withColumn("run_n", F.sum("n").over(Window.partitionBy("column").orderBy("value")))
        else:
            inside = running_totals(inside, "value", ["n"], by=["column"])
        rank = F.col("rank")
        return (
            inside.join(F.broadcast(wanted), "column")  # two rows a column and quantile
            .where((F.col("run_n") - F.col("n") <= rank) & (rank < F.col("run_n")))
            .groupBy(F.col("name").alias("column"), "prob")
            .agg(
                F.max("part").alias("part"),
                F.max(F.when(F.col("lower"), F.col("value"))).alias("low"),
                F.max(F.when(~F.col("lower"), F.col("value"))).alias("high"),
            )
            .select(
                "column", "prob",
                # A rank that is whole has no higher neighbour.
                F.when(F.col("high").isNull() | (F.col("high") == F.col("low")), F.col("low"))
                .otherwise(F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("value"),
            )
        )


def _merged(spans: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint spans in order; those that touch become one."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], approx: bool = False
) -> DataFrame:
    """Quantiles with linear interpolation, one row per ``(column, prob)``.

    Exact ones come from a :class:`Selection`. ``approx=True`` reads Spark's mergeable sketch
    alone, in one scan.
    """
    if not approx:
        return Selection(df, columns, probs).quantiles()
    clean = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    picked = clean.agg(*[F.percentile_approx(c, list(probs), F.lit(10_000)).alias(c) for c in columns])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(p).alias("prob"), F.get(c, F.lit(i)).alias("value"))
        for c in columns
        for i, p in enumerate(probs)
    ]
    return picked.select(F.inline(F.array(*rows)))


def quantile_row(df: DataFrame, columns: Sequence[str], prob: float, approx: bool = False) -> DataFrame:
    """The same quantile of several columns as one wide row ``q_<column>``."""
    return quantiles(df, columns, [prob], approx).agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"q_{c}") for c in columns]
    )
