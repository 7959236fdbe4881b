"""Quality rules on lines and words, and line frequency across the documents of a host.

Every text yields its counts and the hashes of its normalised lines in one scan
with built-in functions; only hashes and counts are shuffled. A line that occurs
in more than ``line_limit`` distinct documents of one host is removed, and a
document that keeps too little is rejected.

Documents are told apart by a digest of their whole text, so exact copies of one
document count once and never make their own lines frequent. Texts that differ
anywhere count as different documents, however many lines they share.

Defined results: a null or empty text has no words and fails the base rules; a
null host is a host of its own; repeated rows count as one document and each keep
their verdict; very long texts are read whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import free_name
from tidewatch.session import materialize

LINE_LIMIT = 50  # distinct documents of a host that may share a line
MIN_LEFT_PERCENT = 30  # words that must remain after frequent lines are removed
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SPACE = r"[\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
NORMAL_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789\x09\x0b\x0c\x0d"
NORMAL_TO = "abcdefghijklmnopqrstuvwxyz000000000\x20\x20\x20\x20"


def _hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def profile(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """One row per document: its counts, ``_document`` (hash of its text), ``_lines`` (hash and words of each line with a word)."""
    text = docs.select(*keep, F.coalesce("source", F.lit("")).alias("_host"), F.coalesce("text", F.lit("")).alias("_text"))
    words = text.select(
        "*",
        F.transform(F.array_remove(F.split("_text", SPACE), ""), lambda w: F.xxhash64(w)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("_raw"),
        F.filter(
            F.transform(
                F.split(F.regexp_replace(F.translate("_text", NORMAL_FROM, NORMAL_TO), " +", " "), "\n"),
                lambda x: F.trim(x),
            ),
            lambda x: x != "",
        ).alias("_normal"),
    )
    grams = words.select(
        "*",
        F.when(
            F.size("_words") >= 3,
            F.zip_with(
                F.slice("_words", F.lit(1), F.size("_words") - 2),
                F.zip_with(
                    F.slice("_words", F.lit(2), F.size("_words") - 2),
                    F.slice("_words", F.lit(3), F.size("_words") - 2),
                    lambda b, c: F.xxhash64(b, c),
                ),
                lambda a, bc: F.xxhash64(a, bc),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_grams"),
    )
    # A window is repeated if it stands next to an equal one in sorted order.
    ordered = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    seen = grams.select(
        "*",
        F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), ordered).alias("_sorted"),
    )
    twice = F.filter(
        "_sorted",
        lambda s, k: (F.get("_sorted", k - 1)["g"] == s["g"]) | (F.get("_sorted", k + 1)["g"] == s["g"]),
    )
    repeated = F.size(
        F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    )
    return seen.select(
        *[c for c in text.columns if c != "_text"],
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _hash(F.col("_text")).alias("_document"),
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(repeated).cast("bigint").alias("n_repeat_words"),
        F.transform(
            "_normal", lambda x: F.struct(_hash(x).alias("h"), F.size(F.split(x, " ")).alias("w"))
        ).alias("_lines"),
    )


def frequent_lines(profiled: DataFrame, line_limit: int = LINE_LIMIT) -> DataFrame:
    """(host, line hash, documents) of the lines in more than ``line_limit`` documents of the host."""
    lines = profiled.select("_host", "_document", F.explode(F.array_distinct(F.col("_lines.h"))).alias("_h"))
    return (
        lines.groupBy("_host", "_h", "_document")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_host", "_h")
        .agg(F.count("*").alias("n_documents"))
        .where(F.col("n_documents") > line_limit)
    )


def judge(
    docs: DataFrame,
    keep: list[str],
    line_limit: int = LINE_LIMIT,
    min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """``keep`` columns with the counts, base verdict, removed words and final verdict of every row."""
    return _judged(docs, keep, line_limit, min_left_percent).drop("_gone")


def _judged(docs: DataFrame, keep: list[str], line_limit: int, min_left_percent: int) -> DataFrame:
    """The verdicts, and the hashes of the frequent lines of every row in ``_gone``."""
    keyed = profile(docs, [F.col(c) for c in keep]).withColumn("_row", F.monotonically_increasing_id())
    keyed = materialize(keyed)  # counts and hashes only; fixes the row numbers
    removed = (
        keyed.select("_row", "_host", F.explode("_lines").alias("_line"))
        .groupBy("_row", "_host", F.col("_line.h").alias("_h"))
        .agg(F.sum("_line.w").alias("_w"), F.count("*").alias("_n"))
        .join(frequent_lines(keyed, line_limit), ["_host", "_h"])
        .groupBy("_row")
        .agg(F.sum("_w").alias("_w"), F.sum("_n").alias("_n"), F.collect_list("_h").alias("_gone"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("n_removed_words") > 0) & (
        100 * (F.col("n_words") - F.col("n_removed_words")) < min_left_percent * F.col("n_words")
    )
    return (
        keyed.join(removed, "_row", "left")
        .select(
            *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"),
            F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_frequent_lines"),
            F.coalesce("_w", F.lit(0)).cast("bigint").alias("n_removed_words"),
            "_gone",
        )
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose normalised form has one of the hashes ``gone``; other lines stay as they are."""
    lines = F.split(text, "\n")
    normal = F.transform(
        F.split(F.regexp_replace(F.translate(text, NORMAL_FROM, NORMAL_TO), " +", " "), "\n"), lambda x: F.trim(x)
    )
    left = F.filter(
        F.zip_with(lines, F.transform(normal, _hash), lambda x, h: F.struct(x.alias("x"), h.alias("h"))),
        lambda s: ~F.array_contains(gone, s["h"]),
    )
    return F.when(F.size(gone) > 0, F.array_join(left["x"], "\n")).otherwise(text)


def keep_good(docs: DataFrame, line_limit: int = LINE_LIMIT, min_left_percent: int = MIN_LEFT_PERCENT) -> DataFrame:
    """The documents that pass, without their frequent lines; ``n_chars``, if there, follows the text.

    Verdict and lines depend on text and host, so they are joined on these.
    """
    key, host, good_key, good_host, gone, clean = (
        free_name(docs, c) for c in ("line_key", "line_host", "good_key", "good_host", "gone_lines", "clean")
    )
    marked = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")))).withColumn(
        host, F.coalesce(F.col("source"), F.lit(""))
    )
    good = (
        _judged(marked, [key, host], line_limit, min_left_percent)
        .where("kept")
        .groupBy(F.col(f"`{key}`").alias(good_key), F.col(f"`{host}`").alias(good_host))
        .agg(F.coalesce(F.any_value("_gone"), F.array().cast("array<bigint>")).alias(gone))
    )
    same = (F.col(f"`{key}`") == F.col(good_key)) & (F.col(f"`{host}`") == F.col(good_host))
    out = marked.join(good, same).withColumn(clean, without_lines(F.col("text"), F.col(gone)))
    changed = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size(gone) > 0, F.length(clean).cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
