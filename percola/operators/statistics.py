"""Statistics that compare scores: correlation, overlap, screens, regression."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percola.operators.ranking import average_rank, column_quantiles
from percola.session import Staged


def spearman(df: DataFrame, x: str, y: str, staged: Staged | None = None) -> DataFrame:
    """Rank correlation over rows where both are present, ties at their average rank."""
    staged = staged or Staged(df.sparkSession)
    both = staged.put(df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null"), "scores")
    ranked = average_rank(average_rank(both, "x", "rx", staged), "y", "ry", staged)
    return ranked.agg(F.corr("rx", "ry").alias("spearman"))


def half_even(n: float) -> int:
    """Rounding of ties to even."""
    return round(n)


def top_overlap(df: DataFrame, low: str, high: str, fraction: float = 0.05, key: str = "node", staged: Staged | None = None) -> DataFrame:
    """(n_top, n_both, jaccard) of the k rows least in `low` and the k greatest in `high`, k = max(1, fraction of rows); ties by key.

    The three columns are written once; the count and both sorts read them.
    """
    df = (staged or Staged(df.sparkSession)).put(df.select(*dict.fromkeys([key, low, high])), "scores")
    n = df.count()
    k = max(1, half_even(fraction * n))
    a = df.where(F.col(low).isNotNull()).orderBy(low, key).limit(k).select(key)
    b = df.where(F.col(high).isNotNull()).orderBy(F.desc(high), key).limit(k).select(key)
    u = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), key, "full")
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return u.agg(F.lit(k).cast("long").alias("n_top"), both.alias("n_both"), F.when(F.count("*") > 0, both / F.count("*")).alias("jaccard"))


def hidden_vulnerable(df: DataFrame, score: str, degree: str, betweenness: str, staged: Staged | None = None) -> DataFrame:
    """Rows in the lowest quarter of score whose degree and betweenness are at most their medians.

    df is evaluated twice: for the three quantiles at once, and for the rows.
    """
    q = column_quantiles(df, {score: [0.25], degree: [0.5], betweenness: [0.5]}, staged)
    return df.where((F.col(score) <= F.lit(q[score][0])) & (F.col(degree) <= F.lit(q[degree][0])) & (F.col(betweenness) <= F.lit(q[betweenness][0])))


def rank_disagreement(df: DataFrame, first: str, second: str) -> DataFrame:
    """df with a flag: in the first quarter by one rank and the last quarter by the other."""
    n = F.lit(df.count())
    early = lambda c: F.col(c) <= n / 4
    late = lambda c: F.col(c) >= 3 * n / 4
    return df.withColumn("rank_disagreement", (early(first) & late(second)) | (early(second) & late(first)))


def min_max_size(df: DataFrame, column: str, low: float = 6.0, high: float = 60.0, constant: float = 20.0) -> DataFrame:
    """df with `size`: column scaled to [low, high], or constant if all its values are equal."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = low + (high - low) * (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return df.crossJoin(F.broadcast(ends)).withColumn("size", F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(F.lit(constant))).drop("_lo", "_hi")


def coordinate_check(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(n_rows, n_missing, n_out_of_range): null or NaN coordinates, and those outside their ranges."""
    missing = F.col(lat).isNull() | F.col(lon).isNull() | F.isnan(lat) | F.isnan(lon)
    outside = ~missing & ~(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    return df.agg(F.count("*").alias("n_rows"), F.count_if(missing).alias("n_missing"), F.count_if(outside).alias("n_out_of_range"))


def null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, n_with_null): rows, and those with a null or NaN in any of the columns (all by default)."""
    kinds = dict(df.dtypes)
    empty = [F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull() for c in columns or df.columns]
    return df.agg(F.count("*").alias("n_rows"), F.count_if(reduce(lambda a, b: a | b, empty)).alias("n_with_null"))


def with_coordinates(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows that have both, neither null nor NaN."""
    return df.dropna(subset=[lat, lon])


def group_mean(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """df with the mean of its group (null is a group): summed up in tasks before it moves, then joined, so that no group is one task's."""
    means = df.groupBy(F.col(group).alias("_group")).agg(F.avg(value).alias(name))
    return df.join(means, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def least_squares(df: DataFrame, target: str, predictors: list[str]) -> tuple[np.ndarray, float | None]:
    """(coefficients with the intercept first, R2) from one aggregation of centred cross-products; the least-norm solution if predictors depend on each other.

    R2 is None if the target doesn't vary. Rows with a null are left out.
    """
    names = [*predictors, target]
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]).dropna()
    k = len(names)
    means = rows.agg(*[F.avg(f"v{i}").alias(f"v{i}") for i in range(k)]).first()
    if means[0] is None:
        return np.zeros(k), None
    mean = np.array([float(m) for m in means])
    z = [F.col(f"v{i}") - F.lit(float(mean[i])) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.agg(*[F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    c = np.zeros((k, k))
    for (i, j), s in zip(pairs, sums, strict=True):
        c[i, j] = c[j, i] = s
    scale = np.sqrt(np.where(np.diag(c) > 0, np.diag(c), 1.0))
    c = c / scale[:, None] / scale[None, :]
    beta = np.linalg.pinv(c[:-1, :-1], rcond=1e-12) @ c[:-1, -1]
    r2 = float(beta @ c[:-1, -1]) if np.diag(c)[-1] > 0 else None
    beta = beta * scale[-1] / scale[:-1]
    return np.concatenate([[mean[-1] - beta @ mean[:-1]], beta]), r2


def residuals(df: DataFrame, target: str, predictors: list[str], coefficients: np.ndarray, name: str = "regression_residual") -> DataFrame:
    fitted = reduce(lambda a, b: a + b, [F.lit(float(c)) * F.col(p) for p, c in zip(predictors, coefficients[1:], strict=True)], F.lit(float(coefficients[0])))
    return df.withColumn(name, F.col(target) - fitted)


def fidelity(p: str, q: str) -> Column:
    """Overlap of two distributions: the sum of square roots of products."""
    return F.sum(F.sqrt(F.col(p) * F.col(q)))


def largest_difference(p: str, q: str) -> Column:
    return F.max(F.abs(F.col(p) - F.col(q)))


def total_variation(p: str, q: str) -> Column:
    return F.sum(F.abs(F.col(p) - F.col(q))) / 2


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.agg((F.count("*") - F.count_distinct(*keys)).alias("n_duplicates"))
