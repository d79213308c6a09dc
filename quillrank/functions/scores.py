"""Score expressions: decays, normalisations, soft labels."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ROUND = 6


def decay(kind: str, position: Column) -> Column:
    """Weight of a 0-based position: "reciprocal", "log" or "exp"."""
    p = position.cast("double")
    if kind == "reciprocal":
        return 1 / (p + 1)
    if kind == "log":
        return 1 / F.ln(p + 2)
    if kind == "exp":
        return F.exp(-0.3 * p)
    raise ValueError(f"unknown decay {kind!r}")


def pooled(kind: str, score: Column) -> Column:
    if kind == "sum":
        return F.sum(score)
    if kind == "max":
        return F.max(score)
    raise ValueError(f"unknown pool {kind!r}")


def min_max(score: Column, by: list[str]) -> Column:
    """To 0..1 within by; 0 where all are equal."""
    w = Window.partitionBy(*by)
    low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    return F.when(span == 0, F.lit(0.0)).otherwise((score - low) / span)


def by_max(score: Column, by: list[str]) -> Column:
    """Over the greatest of the group; as it is where that isn't positive."""
    top = F.max(score).over(Window.partitionBy(*by))
    return F.when(top > 0, score / top).otherwise(score)


def softmax(score: Column, by: list[str], alpha: float = 1.0) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(alpha * (score - F.max(score).over(w)))
    return e / F.sum(e).over(w)


def logsumexp(score: str, by: list[str]):
    """A function DataFrame -> DataFrame with ln(sum(exp(score))) for each group, stable."""

    def run(df):
        top = df.withColumn("_top", F.max(score).over(Window.partitionBy(*by)))
        return top.groupBy(*by).agg((F.max("_top") + F.ln(F.sum(F.exp(F.col(score) - F.col("_top"))))).alias("logsumexp"))

    return run


def soft_label(matched: Column, expected: Column, frequencies: Column, epsilon: float = 0.05, most: int = 200) -> Column:
    """epsilon for no match, else 0.5 + (0.5 - epsilon) * coverage * mean of min(1, ln(1+f)/ln(1+most)), within
    epsilon..1-epsilon. frequencies: array of the matched citations' global frequencies."""
    spread = F.aggregate(frequencies, F.lit(0.0), lambda a, f: a + F.least(F.lit(1.0), F.ln(f.cast("double") + 1) / F.ln(F.lit(1.0 + most))))
    mean = spread / F.greatest(F.size(frequencies), F.lit(1))
    value = 0.5 + (0.5 - epsilon) * (matched / F.greatest(expected, F.lit(1))) * mean
    return F.when(matched == 0, F.lit(epsilon)).otherwise(F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), value)))


def rounded(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, ROUND)
