"""Tail probabilities for drift tests as SQL expressions (evaluated on one row per column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KS_TERMS = 100
ERF_TERMS = 200
LARGE_DF = 10_000  # beyond, the tail is taken from its normal form


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value, clamped to [0, 1]."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    lam = F.sqrt(n1 * n2 / (n1 + n2)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * k * k * lam * lam),
    )
    # Below 0.2 the alternating series has not converged and the true value is 1.
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))


def _erf_sqrt(h: Column) -> Column:
    """erf(sqrt(h)) by its all-positive series; 1 beyond h = 30."""
    term0 = 2 * F.sqrt(h / F.pi()) * F.exp(-h)
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(ERF_TERMS)),
        F.struct(term0.alias("sum"), term0.alias("term")),
        lambda s, n: F.struct(
            (s["sum"] + s["term"] * 2 * h / (2 * n + 1)).alias("sum"),
            (s["term"] * 2 * h / (2 * n + 1)).alias("term"),
        ),
        lambda s: s["sum"],
    )
    return F.when(h > 30, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def chi_square_p_value(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution for integer ``df``; 1 when ``df`` is 0.

    Even df: a Poisson sum. Odd df: erfc plus a sum over half-integer gammas.
    Terms are added as exponentials of logs so that large ``x`` does not underflow.
    """
    h = x.cast("double") / 2
    few = F.least(df, F.lit(LARGE_DF))  # the sums below stay short
    return F.when(df > LARGE_DF, _wilson_hilferty(x.cast("double"), df.cast("double"))).otherwise(_chi_square_sum(h, few))


def _wilson_hilferty(x: Column, df: Column) -> Column:
    """Normal form of the cube root, off by less than 1e-5 for the large ``df`` it is used for."""
    spread = 2 / (9 * df)
    z = (F.cbrt(x / df) - (1 - spread)) / F.sqrt(spread)
    inside = _erf_sqrt(z * z / 2)
    return F.when(z > 0, (1 - inside) / 2).otherwise((1 + inside) / 2)


def _chi_square_sum(h: Column, df: Column) -> Column:
    odd = df % 2 == 1
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    # first term: ln(e^-h h^s / Gamma(s+1)) with s = 0 (even) or 1/2 (odd)
    first = -h + F.when(odd, 0.5 * F.ln(h) - F.ln(F.sqrt(F.pi()) / 2)).otherwise(F.lit(0.0))
    steps = F.when(df >= 4, F.sequence(F.lit(1), (F.floor(df / 2) - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    tail = F.aggregate(
        steps,
        F.struct(F.exp(first).alias("sum"), first.alias("log")),
        lambda s, i: F.struct(
            (s["sum"] + F.exp(s["log"] + F.ln(h) - F.ln(i + shift))).alias("sum"),
            (s["log"] + F.ln(h) - F.ln(i + shift)).alias("log"),
        ),
        lambda s: s["sum"],
    )
    erfc = 1 - _erf_sqrt(h)
    p = F.when(df <= 0, F.lit(1.0)).when(h <= 0, F.lit(1.0)).when(df == 1, erfc).when(odd, erfc + tail).otherwise(tail)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
