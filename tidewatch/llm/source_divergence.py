"""How far the sources of a language differ in their vocabulary, from run-length columns of counts.

Terms are counted once per language, source and term (combined in the task before the shuffle), and
those in too few documents of the language are left out. The kept vocabulary of a language is cut into
segments by a hash of the term, as many for each, so that terms times sources of one stay near ``CELLS``. Inside a
segment terms are reordered by their counts in the most common source, then the next one,
and so on: equal counts come together. Every source's column is then kept as runs of
equal counts; for a pair of sources the run boundaries are intersected and the
divergence of each common run is multiplied by its length. Segments add up.

Shares are integers: ``1 + floor(UNIT * (count + EXTRA) / (total + EXTRA * terms))``. All sums are exact.

Defined results: null text, language and source count as empty; very long texts are counted
whole; repeated rows are documents of their own; a group without kept terms stands in the
pairs; a language without kept terms has the value 0 for all its pairs; equal values rank by
item; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks
from tidewatch.session import materialize

MIN_DOCUMENTS = 10
UNIT = 1_000_000_000
EXTRA = 2
TOP = 10
CELLS = 500_000  # counts of one segment
HELD_TERMS = 200_000  # counters a task holds before it passes them on
SAFE = 9_000_000_000  # larger counts times UNIT pass 64 bits

COUNTS = "lang string, source string, term string, n long, docs long"
PAIRS = "lang string, source string, item string, value long"

# In UTF-8 every byte of a character beyond ASCII is 0x80 or more: terms are runs of such bytes and letters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, letters A to Z in lower case."""
    return text.translate(_FOLD).split()


def _filled(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def count_terms(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each term of each group."""

    def flush(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in groups.items():
            same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(counts), np.int32))) for x in (lang, source)]
            columns = [
                *same,
                pa.array(counts.keys(), pa.binary()).cast(pa.string()),
                pa.array(counts.values(), pa.int64()),
                pa.array([documents[t] for t in counts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0
        for batch in chunks(batches):
            lang, source, text = batch.columns
            for *group, body in zip(lang.to_pylist(), source.to_pylist(), text.cast(pa.binary()).to_pylist()):
                counts, documents = groups.setdefault(tuple(group), (Counter(), Counter()))
                found = terms(body)
                held -= len(counts)
                counts.update(found)
                documents.update(set(found))
                held += len(counts)
                if held > HELD_TERMS:
                    yield from flush(groups)
                    groups, held = {}, 0
        yield from flush(groups)

    partial = _filled(docs).mapInArrow(run, COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(lang, source, term, n, lang_n)`` of the kept terms that occur in a group."""
    term = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    summed = count_terms(docs).select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("in_docs")
    )
    return summed.where(F.col("in_docs") >= min_documents).drop("in_docs")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, total, lang_total, kept_terms)`` of every group, also those without terms."""
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = (
        kept.groupBy("lang", "term")
        .agg(F.first("lang_n").alias("lang_n"))
        .groupBy("lang")
        .agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("kept_terms"))
    )
    groups = _filled(docs).select("lang", "source").distinct()
    zero = F.lit(0).cast("long")
    return (
        groups.join(per_group, ["lang", "source"], "left")
        .join(per_lang, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "kept_terms")])
    )


def _share(count: str, total: str) -> str:
    """Spark form of a share; decimals hold any product."""
    size = f"CAST({total} AS DECIMAL(20,0)) + {EXTRA} * CAST(kept_terms AS DECIMAL(18,0))"
    return f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * (CAST({count} AS DECIMAL(19,0)) + {EXTRA})) div ({size})"


def top_terms(kept: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The terms by which a group exceeds its language most."""
    shares = kept.join(totals, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        F.expr(_share("n", "total")).alias("p"), F.expr(_share("lang_n", "lang_total")).alias("q"),
    )
    value = F.expr("((p - q) * (p - q)) div (p + q)").alias("value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # Spark prunes to the first rows of each group before the shuffle.
    return (
        shares.where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), "item", value)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top)
    )


def shares_of(counts: np.ndarray, total: int, kept_terms: int) -> np.ndarray:
    big = len(counts) and int(counts.max()) > SAFE
    wide = counts.astype(object) if big else counts.astype(np.int64)
    return (1 + UNIT * (wide + EXTRA) // (total + EXTRA * kept_terms)).astype(np.int64)


def run_lengths(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and value of every run of equal counts."""
    starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    return starts, column[starts]


def reordered(counts: np.ndarray) -> np.ndarray:
    """Rows (terms) sorted by their counts in the most common column, then the next one, ..."""
    common = np.argsort(-(counts > 0).sum(axis=0), kind="stable")
    return counts[np.lexsort(counts[:, common[::-1]].T)] if counts.shape[1] else counts


def divergence(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int) -> int:
    """Sum over all rows of two run-length columns of shares."""
    starts = np.union1d(a[0], b[0])
    lengths = np.diff(starts, append=rows)
    p = a[1][np.searchsorted(a[0], starts, side="right") - 1]
    q = b[1][np.searchsorted(b[0], starts, side="right") - 1]
    return int(((p - q) * (p - q) // (p + q) * lengths).sum())


def pair_values(kept: DataFrame, totals: DataFrame, cells: int = CELLS) -> DataFrame:
    """``(lang, source, item, value)`` of every ordered pair of sources of a language."""
    sized = totals.groupBy("lang").agg((F.max("kept_terms") * F.count("*")).alias("cells"))
    segments = 1 + (sized.agg(F.max("cells")).first()[0] or 0) // cells
    rows = kept.select(
        "lang", F.pmod(F.xxhash64("term"), F.lit(segments)).cast("long").alias("segment"), "source", "term", "n"
    )
    # Every segment needs all sources of its language, those without a term in it too.
    heads = totals.select(
        "lang",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(segments - 1).cast("long"))).alias("segment"),
        "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", "kept_terms",
    )

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        head = part[part["term"].isna()].sort_values("source")
        body = part[part["term"].notna()]
        sources = head["source"].tolist()
        n_terms = body["term"].nunique()
        counts = np.zeros((n_terms, len(sources)), np.int64)
        place = {s: i for i, s in enumerate(sources)}
        counts[pd.factorize(body["term"])[0], body["source"].map(place).to_numpy(np.int64)] = body["n"].to_numpy(np.int64)
        counts = reordered(counts)
        columns = []
        for i, (total, kept_terms) in enumerate(zip(head["total"], head["kept_terms"])):
            if n_terms:
                starts, values = run_lengths(counts[:, i])
                columns.append((starts, shares_of(values, int(total), int(kept_terms))))
        out = []
        for i in range(len(sources)):
            for j in range(i):
                value = divergence(columns[i], columns[j], n_terms) if n_terms else 0
                out += [(key[0], sources[i], sources[j], value), (key[0], sources[j], sources[i], value)]
        return pd.DataFrame(out, columns=["lang", "source", "item", "value"])

    parts = rows.unionByName(heads, allowMissingColumns=True).groupBy("lang", "segment").applyInPandas(compare, PAIRS)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """Pairs of sources and outstanding terms of each group, ranked by value.

    ``docs`` holds ``text``, ``lang`` and ``source``.
    """
    kept = materialize(kept_counts(docs, min_documents))
    totals = materialize(group_totals(docs, kept))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, totals, cells).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank")
    )
    return pairs.unionByName(top_terms(kept, totals, top))
