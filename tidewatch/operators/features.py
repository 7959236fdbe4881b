"""Feature engineering and train/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.columns import average_spend, divide_or_zero, tenure_bucket
from tidewatch.operators.joins import lookup_join
from tidewatch.operators.ordered import number_rows
from tidewatch.session import materialize

MAX_ONE_HOT_LEVELS = 256
HASH_PREFIX = 4  # hex digits: 65,536 equal slices of the hash range


def features_and_target(df: DataFrame, configured: Sequence[str], target: str) -> DataFrame:
    """Configured feature columns that exist (else all others), then the target."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the table")
    present = [c for c in configured if c in df.columns] or [c for c in df.columns if c != target]
    return df.select(*present, target)


def engineer(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "avg_monthly_spend": average_spend("MonthlyCharges", "TotalCharges", "tenure"),
            "tenure_bucket": tenure_bucket("tenure"),
        }
    )


def target_means(df: DataFrame, category: str, target: str, out: str) -> DataFrame:
    return df.groupBy(category).agg(F.avg(target).alias(out))


def target_encode(train: DataFrame, rows: DataFrame, category: str, target: str, out: str) -> DataFrame:
    """Mean target by category, learnt on ``train`` only; unseen categories get the global mean."""
    known = target_means(train.where(F.col(category).isNotNull()), category, target, "_mean")
    overall = train.agg(F.avg(target).alias("_overall"))
    joined = lookup_join(rows, known, [category]).join(F.broadcast(overall))  # one row
    return joined.select(*rows.columns, F.coalesce("_mean", "_overall").alias(out))


def standardize(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std; a constant column becomes 0. Statistics are one row."""
    fitted_on = df if fitted_on is None else fitted_on
    stats = fitted_on.agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_std_{c}") for c in columns]
    )
    scaled = {
        c: F.when(
            F.col(c).isNotNull(), divide_or_zero(F.col(c) - F.col(f"_mean_{c}"), F.nullif(F.col(f"_std_{c}"), F.lit(0.0)))
        )
        for c in columns
    }
    return df.join(F.broadcast(stats)).select(*[scaled.get(c, F.col(c)).alias(c) for c in df.columns])


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``(column, code)``: position of each distinct value in sorted order, from 0."""
    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    return number_rows(levels, column, "code").withColumn("code", F.col("code") - 1)


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    codes = label_codes(df, column).withColumnRenamed("code", out)
    return lookup_join(df, codes, [column]).select(*df.columns, out)


def one_hot(df: DataFrame, column: str, max_levels: int = MAX_ONE_HOT_LEVELS) -> DataFrame:
    """0/1 columns for all sorted levels but the first; null gives all zeros.

    The levels become column names, so they are read on the driver; more than
    ``max_levels`` is an error (``one_hot_entries`` takes any number).
    """
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels")
    levels = sorted(r[0] for r in found)
    flags = [F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in levels[1:]]
    return df.select(*[c for c in df.columns if c != column], *flags)


def one_hot_entries(df: DataFrame, column: str, key: str) -> DataFrame:
    """``(key, index)`` of the flags that ``one_hot`` would set, for any number of levels.

    The index counts the sorted levels from 0 without the first; rows of the first level
    or without one have no entry. Levels are joined on, never read on the driver.
    """
    return (
        label_encode(df, column, "_code")
        .where(F.col("_code") > 0)
        .select(key, (F.col("_code") - 1).alias("index"))
    )


def encode(df: DataFrame, columns: Sequence[str], method: str = "onehot") -> DataFrame:
    for c in columns:
        if method == "onehot":
            df = one_hot(df, c)
        elif method == "label":
            renamed = df.withColumn(c, F.col(c).cast("string"))
            df = label_encode(renamed, c, f"_{c}").drop(c).withColumnRenamed(f"_{c}", c)
        else:
            raise ValueError(f"unknown encoding {method!r}")
    return df


def hash_position(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def stratified_parts(df: DataFrame, label: str, key: str, parts: Sequence[float], out: str = "part") -> DataFrame:
    """Number each row with the part it falls in, splitting every class exactly.

    Rows of a class are ordered by the hash of their unique key; ``parts`` are
    the cumulative shares at which one part ends and the next begins. Only the
    position of the cuts is computed: a histogram over hash slices finds the
    slice of each cut, and just that slice is ranked. The rows themselves are
    not shuffled, they are compared with the cut hashes of their class.
    """
    hashed = df.select(F.col(label).alias("_label"), hash_position(key).alias("_hash"))
    slices = materialize(
        hashed.groupBy("_label", F.substring("_hash", 1, HASH_PREFIX).alias("_slice")).agg(F.count("*").alias("_n"))
    )
    # At most 65,536 slices per class.
    order = Window.partitionBy("_label").orderBy("_slice")
    totals = Window.partitionBy("_label")
    cuts = slices.select(
        "_label",
        "_slice",
        (F.sum("_n").over(order) - F.col("_n")).alias("_before"),
        F.sum("_n").over(order).alias("_through"),
        F.sum("_n").over(totals).alias("_total"),
    ).select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in parts])).alias("_cut", "_share"))
    wanted = F.floor(F.col("_share") * F.col("_total") + 1e-9)
    cuts = (
        cuts.withColumn("_rank", wanted)
        .where(
            ((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_through")))
            | ((F.col("_rank") == 0) & (F.col("_before") == 0))
        )
        .select("_label", "_slice", "_cut", (F.col("_rank") - F.col("_before")).alias("_nth"))
    )
    # A few cuts a class: Spark broadcasts them as long as the classes are few.
    inside = hashed.withColumn("_slice", F.substring("_hash", 1, HASH_PREFIX)).join(cuts, ["_label", "_slice"])
    nth = Window.partitionBy("_label", "_cut").orderBy("_hash")
    limits = (
        inside.withColumn("_row", F.row_number().over(nth))
        .where(F.col("_row") == F.greatest("_nth", F.lit(1)))
        .groupBy("_label")
        # an empty first part is cut before every hash
        .agg(F.collect_list(F.when(F.col("_nth") == 0, F.lit("")).otherwise(F.col("_hash"))).alias("_limits"))
        .withColumnRenamed("_label", label)
    )
    position = hash_position(key)
    part = F.size(F.filter(F.coalesce("_limits", F.array().cast("array<string>")), lambda h: h < position))
    return df.join(limits, label, "left").select(*df.columns, part.alias(out))


def stratified_split(df: DataFrame, label: str, key: str, train_share: float = 0.8) -> DataFrame:
    """Add ``is_train``: exactly floor(share * n) rows of each class."""
    return (
        stratified_parts(df, label, key, [train_share], "_part")
        .withColumn("is_train", F.col("_part") == 0)
        .drop("_part")
    )


def stratified_folds(df: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """Add ``fold`` 0..folds-1 with equal class shares."""
    return stratified_parts(df, label, key, [i / folds for i in range(1, folds)], "fold")
