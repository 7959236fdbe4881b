"""Data-quality profile of a table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.operators.ordered import Selection, nan_to_null, quantiles, unpivot_numeric

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
CODED_COLUMNS = 16  # up to here a correlation matrix is one generated aggregate
ORIGIN_ROWS = 100  # rows that say where the values lie
GRAM_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy", "bad"]
KERNEL_TERMS = 12
KERNEL_REACH = 9  # bandwidths; the kernel is below 3e-18 beyond


def columns_of(df: DataFrame, kind: type[T.DataType]) -> list[str]:
    """Names of the columns whose type belongs to a class such as NumericType."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.NumericType)


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType)


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    missing = F.col(name).isNull()
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(name)
    return missing


def _as_rows(names: Sequence[str], *fields: tuple[str, str]) -> Column:
    """Turn wide aggregate columns ``<prefix>_<name>`` into rows."""
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(n).alias("column"), *[F.col(f"{prefix}_{n}").alias(out) for prefix, out in fields])
                for n in names
            ]
        )
    )


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing cells per column, one pass."""
    wide = df.agg(
        F.count("*").alias("n"), *[F.count_if(is_missing(df, c)).alias(f"nulls_{c}") for c in df.columns]
    )
    return wide.select("n", _as_rows(df.columns, ("nulls", "n_missing"))).select(
        "column", "n_missing", F.coalesce(F.try_divide(F.col("n_missing") * 100.0, "n"), F.lit(0.0)).alias("pct_missing")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows; nulls are equal."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count("*").alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicates"),
        )
    )


def value_counts(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep…, column, value, n)`` in one shuffle for all columns, combined map-side."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs))).groupBy(*keep, "column", "value").agg(F.count("*").alias("n"))


def _cell(df: DataFrame, name: str, position: int) -> Column:
    """A cell as (column position, whole number, float, text), so that no number is printed to be compared."""
    kind, c = df.schema[name].dataType, F.col(name)
    whole, real, text = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        whole = c.cast("bigint")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        whole = F.unix_date(c).cast("bigint")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        real = nan_to_null(c.cast("double"))
    else:
        text = c.cast("string")
    return F.struct(
        F.lit(position).alias("position"), whole.alias("whole"), real.alias("real"), text.alias("text")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column."""
    if approx:
        wide = df.agg(*[F.approx_count_distinct(c).alias(f"d_{c}") for c in columns])
        return wide.select(_as_rows(columns, ("d", "n_distinct")))
    present = F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()
    counts = (
        df.select(F.inline(F.array(*[_cell(df, c, i) for i, c in enumerate(columns)])))
        .distinct()
        .groupBy("position")
        .agg(F.count_if(present).alias("n_distinct"))
    )
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(F.get(names, F.col("position")).alias("column"), "n_distinct")


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column."""
    chosen = Selection(df, columns, list(QUARTILES.values()))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    points = spread_quantiles(chosen.quantiles(), QUARTILES)
    return (
        names.join(F.broadcast(chosen.moments()), "column", "left")  # one row a column; empty columns keep theirs
        .join(points, "column", "left")
        .select("column", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "q25", "q50", "q75", "max")
    )


def spread_quantiles(rows: DataFrame, names: dict[str, float]) -> DataFrame:
    """``(column, prob, value)`` rows as one row per column with named quantiles."""
    return rows.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for name, p in names.items()]
    )


def quantile_columns(df: DataFrame, columns: Sequence[str], names: dict[str, float]) -> DataFrame:
    """One row per column with a quantile in each named output column."""
    return spread_quantiles(quantiles(df, columns, list(names.values())), names)


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values and the distinct count per column; ties by value.

    Spark prunes to k rows per column before the shuffle (WindowGroupLimit).
    """
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    unique = counts.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("n_distinct"))
    return top.join(F.broadcast(unique), "column")  # one row per column


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sum((F.count_if(is_missing(df, c)) for c in columns[1:]), F.count_if(is_missing(df, columns[0])))
    return df.agg(F.count("*").alias("n_rows"), missing.alias("n_missing")).withColumn(
        "completeness", 1 - F.try_divide(F.col("n_missing"), F.col("n_rows") * F.lit(len(columns)))
    )


def iqr_bounds(df: DataFrame, columns: Sequence[str], width: float) -> DataFrame:
    iqr = F.col("q75") - F.col("q25")
    return quantile_columns(df, columns, QUARTILES).select(
        "column", (F.col("q25") - width * iqr).alias("low"), (F.col("q75") + width * iqr).alias("high")
    )


def outlier_rows(df: DataFrame, key: str, columns: Sequence[str], width: float = 1.5) -> DataFrame:
    """``(column, key, value)`` of every value outside the IQR fence."""
    bounds = iqr_bounds(df, columns, width)
    return (
        unpivot_numeric(df, columns, keep=[key])
        .where(F.col("value").isNotNull())
        .join(F.broadcast(bounds), "column")  # one row per column
        .where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
        .select("column", key, "value")
    )


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form, pairwise complete, one pass.

    Up to ``CODED_COLUMNS`` columns are one generated aggregate; more go through :func:`gram_correlation`,
    whose plan does not grow with the pairs.
    """
    if len(columns) > CODED_COLUMNS:
        return gram_correlation(df, columns)
    clean = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = clean.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells.append((a, b, f"r{i}"))
        if a != b:
            cells.append((b, a, f"r{i}"))
    rows = [
        F.struct(F.lit(a).alias("row"), F.lit(b).alias("column"), F.col(r).alias("correlation")) for a, b, r in cells
    ]
    return wide.select(F.inline(F.array(*rows)))


def gram_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same matrix for many columns from block sums: one scan, a few matrix products a batch.

    With values X (0 where missing) and presence M, the products M'M, X'M, (X^2)'M and X'X hold
    count, sums, squares and cross products of every pair over the rows that have both. Tasks
    add them up over their batches; what is shuffled is one row a task and pair. Values are
    taken from a row near the start of the table, so that far-off means cost no digits.

    A pair without common rows, or with a constant side over them, is null; a pair that meets an infinite value is NaN.
    """
    names = list(columns)
    clean = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(names)])
    # Any finite origin is right; it only saves digits.
    near = clean.limit(ORIGIN_ROWS).agg(
        *[F.avg(F.when(F.abs(f"v{i}") != float("inf"), F.col(f"v{i}"))).alias(f"v{i}") for i in range(len(names))]
    )
    origin = np.array([v if v is not None else 0.0 for v in near.first()])
    upper = np.triu_indices(len(names))

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            raw = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            endless = np.isinf(raw)
            seen = (~np.isnan(raw)).astype(float)
            x = np.where((seen == 1) & ~endless, raw - origin, 0.0)
            squares = x * x
            parts = [seen.T @ seen, x.T @ seen, seen.T @ x, squares.T @ seen, seen.T @ squares, x.T @ x]
            bad = np.zeros_like(parts[0])
            if endless.any():
                bad = endless.T.astype(float) @ seen
                bad = bad + bad.T
            parts = np.stack([p[upper] for p in [*parts, bad]])
            sums = parts if sums is None else sums + parts
        if sums is not None:
            arrays = [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), *[pa.array(p) for p in sums]]
            yield pa.RecordBatch.from_arrays(arrays, ["i", "j", *GRAM_SUMS])

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in GRAM_SUMS)
    total = clean.mapInArrow(partial_sums, schema).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in GRAM_SUMS])
    n = F.col("n")
    # What is left of squares that cancel is rounding, not spread.
    dx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    dy = F.col("syy") - F.col("sy") * F.col("sy") / n
    spread = (dx > 1e-12 * F.col("sxx")) & (dy > 1e-12 * F.col("syy"))
    value = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(dx * dy)
    found = (
        F.when(F.col("bad") > 0, F.lit(float("nan")))
        .when((n > 0) & spread, F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)))
    )
    label = F.array(*[F.lit(c) for c in names])
    a, b = F.get(label, F.col("i")), F.get(label, F.col("j"))
    cells = F.array_distinct(
        F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    grid = _pair_grid(df, len(names)).join(total, ["i", "j"], "left")
    return grid.select(F.inline(cells), found.alias("correlation")).select(
        a.alias("row"), b.alias("column"), "correlation"
    )


def _pair_grid(df: DataFrame, width: int) -> DataFrame:
    """``(i, j)`` with i <= j: pairs of columns, so that an empty table keeps its cells."""
    last = F.lit(width - 1)
    return df.sparkSession.range(width).select(
        F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.col("id").cast("int"), last)).alias("j")
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width density histogram; the last bin includes the maximum, empty bins are kept."""
    longform = unpivot_numeric(df, columns).where(F.col("value").isNotNull())
    spread = (
        longform.groupBy("column")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("total"))
        .select(
            "column",
            "total",
            F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"),
            (F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0)) / bins).alias("width"),
        )
    )
    counts = (
        longform.join(F.broadcast(spread), "column")  # one row per column
        .where(F.col("total") > 0)  # keeps the column here, so that the limits are computed once
        .groupBy(
            "column", F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).alias("bin")
        )
        .agg(F.count("*").alias("n"))
    )
    grid = spread.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    return grid.join(counts, ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("total") * F.col("width"))).alias("density"),
    )


def kernel_density(df: DataFrame, column: str, points: int = 1000) -> DataFrame:
    """Gaussian kernel density on an even grid half a range beyond the data, Scott bandwidth.

    Values fall into bins half a bandwidth wide, and a bin keeps the moments of its values about
    its middle, added map-side. The kernel of a whole bin follows from these by its Hermite series; with
    ``KERNEL_TERMS`` terms the rest is below 1e-11 of the kernel's height. Only bins and grid
    points within ``KERNEL_REACH`` bandwidths meet, a few thousand pairs however many rows there are.

    A column without values has no grid; without a deviation (one value, or equal ones) the density is null.
    """
    values = df.select(nan_to_null(F.col(column).cast("double")).alias("value")).where(F.col("value").isNotNull())
    spread = (
        values.agg(
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.stddev_samp("value").alias("std"),
            F.count("*").alias("total"),
        )
        .where(F.col("total") > 0)
        .select(
            "lo",
            (F.col("lo") - 0.5 * (F.col("hi") - F.col("lo"))).alias("start"),
            (2 * (F.col("hi") - F.col("lo")) / (points - 1)).alias("step"),
            F.nullif(F.col("std") * F.pow(F.col("total").cast("double"), F.lit(-0.2)), F.lit(0.0)).alias("bandwidth"),
            "total",
        )
    )
    spread = F.broadcast(spread)  # one row
    scaled = (F.col("value") - F.col("lo")) * 2 / F.col("bandwidth")
    offset = (F.col("value") - F.col("lo")) / F.col("bandwidth") - (F.col("bin") + 0.5) / 2
    moments = (
        values.join(spread)
        .where(F.col("bandwidth").isNotNull())
        .select("value", "lo", "bandwidth", F.floor(scaled).alias("bin"))
        .select("bin", offset.alias("z"))
        .groupBy("bin")
        .agg(*[F.sum(F.pow("z", F.lit(float(j)))).alias(f"m{j}") for j in range(KERNEL_TERMS)])
    )
    series = F.array(*[F.col(f"m{j}") / F.lit(float(math.factorial(j))) for j in range(KERNEL_TERMS)])
    middle = F.col("lo") + (F.col("bin") + 0.5) / 2 * F.col("bandwidth")
    first = F.ceil((F.col("middle") - KERNEL_REACH * F.col("bandwidth") - F.col("start")) / F.col("step"))
    last = F.floor((F.col("middle") + KERNEL_REACH * F.col("bandwidth") - F.col("start")) / F.col("step"))
    near = (
        moments.join(spread)
        .select("start", "step", "bandwidth", series.alias("series"), middle.alias("middle"))
        .select("*", F.greatest(first, F.lit(0)).alias("first"), F.least(last, F.lit(points - 1)).alias("last"))
        .where(F.col("first") <= F.col("last"))
        .withColumn("point", F.explode(F.sequence("first", "last")))
        .withColumn("u", (F.col("start") + F.col("point") * F.col("step") - F.col("middle")) / F.col("bandwidth"))
    )
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("before"), F.lit(1.0).alias("now"), F.lit(0.0).alias("j"))
    hermite = F.aggregate(
        "series",
        zero,
        lambda s, m: F.struct(
            (s["sum"] + m * s["now"]).alias("sum"),
            s["now"].alias("before"),
            (F.col("u") * s["now"] - s["j"] * s["before"]).alias("now"),
            (s["j"] + 1.0).alias("j"),
        ),
        lambda s: s["sum"],
    )
    summed = near.groupBy("point").agg(F.sum(F.exp(-0.5 * F.col("u") * F.col("u")) * hermite).alias("kernel_sum"))
    grid = spread.withColumn("point", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))))
    return grid.join(summed, "point", "left").select(
        "point",
        (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        (
            F.coalesce("kernel_sum", F.lit(0.0)) / (F.col("total") * F.col("bandwidth") * F.sqrt(2 * F.pi()))
        ).alias("density"),
    )


def target_share(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select(  # one row
        F.col(target).cast("bigint").alias("target"), "n", (F.col("n") / F.col("total")).alias("share")
    )


def narrowest_types(df: DataFrame) -> DataFrame:
    """Smallest storage type that holds each column, and which text columns repeat enough to encode."""
    numbers, texts = numeric_columns(df), text_columns(df)
    wide = df.agg(
        F.count("*").alias("n"),
        *[F.min(c).cast("double").alias(f"min_{c}") for c in numbers],
        *[F.max(c).cast("double").alias(f"max_{c}") for c in numbers],
    )
    rows = []
    for c in numbers:
        lo, hi = F.col(f"min_{c}"), F.col(f"max_{c}")
        if isinstance(df.schema[c].dataType, T.IntegralType):
            target = F.lit("bigint")
            for name, bits in (("int", 31), ("smallint", 15), ("tinyint", 7)):
                fits = (lo >= float(-(2**bits))) & (hi <= float(2**bits - 1))
                target = F.when(fits, F.lit(name)).otherwise(target)
        else:
            limit = float(np.finfo(np.float32).max)
            target = F.when(F.greatest(F.abs(lo), F.abs(hi)) <= limit, F.lit("float")).otherwise(F.lit("double"))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(df.schema[c].dataType.simpleString()).alias("from_type"),
                target.alias("to_type"),
            )
        )
    plan = wide.select(F.inline(F.array(*rows))) if rows else None
    if texts:
        total = df.agg(F.count("*").alias("n"))
        repeated = (
            distinct_counts(df, texts)
            .join(F.broadcast(total))  # one row
            .select(
                "column",
                F.lit("string").alias("from_type"),
                F.when(F.col("n_distinct") < 0.5 * F.col("n"), F.lit("dictionary"))
                .otherwise(F.lit("string"))
                .alias("to_type"),
            )
        )
        plan = repeated if plan is None else plan.unionByName(repeated)
    return plan


def model_input_gate(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Checks a table must pass before scoring, one row per check."""
    absent = sorted(set(expected) - set(df.columns))
    extra = sorted(set(df.columns) - set(expected))
    present = [c for c in expected if c in df.columns]
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(is_missing(df, c)).alias(f"nulls_{c}") for c in present])

    def row(check: str, column: str, count: Column, blocking: bool) -> Column:
        return F.struct(
            F.lit(check).alias("check"),
            F.lit(column).alias("column"),
            count.cast("bigint").alias("n"),
            (F.lit(not blocking) | (count == 0)).alias("passed"),
        )

    rows = [row("empty_table", "*", (F.col("n") == 0).cast("int"), True)]
    rows += [row("missing_values", c, F.col(f"nulls_{c}"), True) for c in present]
    rows += [row("absent_column", c, F.lit(1), True) for c in absent]
    rows += [row("extra_column", c, F.lit(1), False) for c in extra]
    return wide.select(F.inline(F.array(*rows)))
