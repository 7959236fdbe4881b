import pytest
from pyspark.sql import functions as F

from tidewatch.operators import profiles, quality

COLUMNS = ["hot", "even", "none", "few"]


@pytest.fixture(scope="module")
def rows(spark):
    """A column with a few hot values, one without, an empty one and one of three values."""
    spread = F.pmod(F.xxhash64("id"), F.lit(30_000))
    return spark.range(0, 60_000, 1, 6).select(
        (F.col("id") % 10).alias("part"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("top"), F.pmod(F.xxhash64("id"), F.lit(7)))).otherwise(
            F.concat(F.lit("v"), spread)
        ).alias("hot"),
        spread.alias("even"),
        F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("few"),
    )


def as_set(df):
    return {(r["column"], r["value"], r["n"], r["rank"]) for r in df.select("column", "value", "n", "rank").collect()}


def test_halves_merge_to_the_whole(spark, rows, tmp_path):
    path = str(tmp_path / "profiles")
    profiles.save_profile(profiles.profile(rows.where("part < 5"), "part", COLUMNS), path)
    profiles.save_profile(profiles.profile(rows.where("part >= 5"), "part", COLUMNS), path)
    stored = profiles.load_profile(spark, path)
    assert stored.count() == 10 * len(COLUMNS)
    got = {r["column"]: r for r in profiles.merged_profile(stored).collect()}
    missing = {r["column"]: r.n_missing for r in quality.null_profile(rows).collect()}
    exact = {r["column"]: r.n_distinct for r in quality.distinct_counts(rows, COLUMNS).collect()}
    for c in COLUMNS:
        assert (got[c].n_rows, got[c].n_missing) == (60_000, missing[c])
        assert abs(got[c].n_distinct - exact[c]) <= 0.04 * exact[c]
    # A part that comes again replaces itself alone.
    profiles.save_profile(profiles.profile(rows.where("part = 3").limit(10), "part", COLUMNS), path)
    again = profiles.merged_profile(profiles.load_profile(spark, path)).where("column = 'hot'").first()
    assert again.n_rows == 60_000 - 6_000 + 10


def test_top_values_are_exact(rows):
    stored = profiles.profile(rows, "part", COLUMNS)
    assert as_set(profiles.top_values(stored, rows, COLUMNS)) == as_set(quality.top_values(rows, COLUMNS))
    part, kept = rows.where("part in (2, 7)"), stored.where("part in (2, 7)")
    assert as_set(profiles.top_values(kept, part, COLUMNS, 3)) == as_set(quality.top_values(part, COLUMNS, 3))
    # Few slots: the sketch is wrong about most values, the answer is not.
    small = profiles.profile(rows, "part", COLUMNS, 16)
    assert as_set(profiles.top_values(small, rows, COLUMNS, 5, 16)) == as_set(quality.top_values(rows, COLUMNS))


def test_candidates_hold_all_frequent_values(rows):
    merged = profiles.merged_profile(profiles.profile(rows, "part", ["hot"], 64), 64)
    found = profiles.candidate_values(merged, 64).collect()
    outside = found[0].outside
    counts = {r["value"]: r["n"] for r in quality.value_counts(rows, ["hot"]).collect()}
    named = {r["value"] for r in found}
    assert 0 < outside and all(v in named for v, n in counts.items() if n > outside)


def test_empty_table(rows):
    none = rows.where("part > 99")
    stored = profiles.profile(none, "part", COLUMNS)
    assert stored.count() == 0 and profiles.merged_profile(stored).count() == 0
    assert profiles.top_values(stored, none, COLUMNS).count() == 0
