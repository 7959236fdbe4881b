"""URL rules: host-suffix and path-prefix expressions, looked up by short hash prefixes.

A rule ``example.org/en/1`` fits the host and every subdomain when the path of
the URL starts with the path of the rule. Each URL is expanded into the
expressions that could be a rule (host suffixes x path prefixes, only of the
depths and lengths that rules have), these meet the rules in an equi-join on the
first hex digits of their SHA-256, the full digest confirms, and the longest rule
wins. Only built-in functions run.

Defined results: a null URL or one without ``://`` has an empty host and path and
no rule; repeated rows each keep their row; of equally long rules the one with the
longer host wins, then ``block``; rules with a null part never fit. Extra columns
of the input are not looked at. A URL of any length is read whole; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_DIGITS = 8  # hex digits of the digest that the join compares: 32 bits
DEFAULT_VERDICT = "allow"  # of URLs that no rule fits

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    mark = F.instr(url, "://")
    return F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise(F.lit(""))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their text, digest and prefix."""
    text = F.concat(F.translate("host", UPPER, LOWER), F.col("path"))
    return (
        rules.select(
            text.alias("rule"),
            F.length("host").alias("host_length"),
            F.col("path").alias("rule_path"),
            F.size(F.split("host", r"\.")).alias("depth"),
            "verdict",
        )
        .where(F.col("rule").isNotNull() & F.col("verdict").isNotNull())
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )


def expressions(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """All texts of rules that could fit: host suffixes of some depths x path prefixes of some lengths."""
    labels = F.split(host, r"\.")
    tails = [
        F.when(F.size(labels) >= d, F.array_join(F.slice(labels, F.size(labels) - (d - 1), F.lit(d)), "."))
        for d in depths
    ]
    heads = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    pairs = F.array(*[F.concat(t, h) for t in tails for h in heads])
    return F.array_compact(pairs)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, host, path, rule (null if none) and verdict of every row.

    The rule depends on host and path alone, so each pair is looked up once, however
    many rows share it. Rules are joined by key; Spark broadcasts them only as long
    as they are small and splits hot keys of a larger join.
    """
    ruled = rule_table(rules)
    # Bounded: no more rows than a host has labels or a path has characters.
    shapes = ruled.select("depth", F.length("rule_path").alias("n")).distinct().collect()
    depths, lengths = sorted({r.depth for r in shapes}), sorted({r.n for r in shapes})
    split = pages.select(*keep, F.col(url).alias("_url")).select(
        *keep,
        F.coalesce(host_of(F.col("_url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("_url")), F.lit("")).alias("path"),
    )
    if not depths:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT_VERDICT).alias("verdict"))
    wanted = (
        split.select("host", "path")
        .where(F.col("host") != "")
        .distinct()
        .select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), depths, lengths)).alias("_text"))
        .withColumn("_digest", F.sha2("_text", 256))
        .withColumn("prefix", F.substring("_digest", 1, PREFIX_DIGITS))
    )
    order = F.struct(F.length("rule"), "host_length", (F.col("verdict") == "block").cast("int"))
    best = (
        wanted.join(ruled.select("prefix", "digest", "rule", "host_length", "verdict"), "prefix")
        .where(F.col("_digest") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), order).alias("_best"))
    )
    return split.join(best, ["host", "path"], "left").select(
        *keep,
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )
