"""Intervals and tests over metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees of freedom up to which Student quantiles are computed one by one; beyond, a series in 1 / df is exact to 1e-9.
STUDENT = 200


def student_cdf(t: float, df: int) -> float:
    """P(T <= t) for t >= 0 and whole degrees of freedom: the finite sums for odd and even df."""
    angle = math.atan(t / math.sqrt(df))
    c, s = math.cos(angle), math.sin(angle)
    if df % 2:
        term, total = c, c if df > 1 else 0.0
        for k in range(3, df - 1, 2):
            term *= c * c * (k - 1) / k
            total += term
        inside = 2 / math.pi * (angle + s * total)
    else:
        term, total = 1.0, 1.0
        for k in range(2, df - 1, 2):
            term *= c * c * (k - 1) / k
            total += term
        inside = s * total
    return 0.5 + inside / 2


def student_quantile(p: float, df: int) -> float:
    """t with P(T <= t) = p, for p > 0.5, by bisection."""
    low, high = 0.0, 1.0
    while student_cdf(high, df) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if student_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2


def student_column(df: Column, confidence: float = 0.95) -> Column:
    """The two-sided quantile for a column of degrees of freedom; null below 1."""
    p = (1 + confidence) / 2
    z = normal_quantile_half(confidence)
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    series = F.lit(z)
    for i, term in enumerate(terms, 1):
        series = series + F.lit(term) / F.pow(df.cast("double"), F.lit(float(i)))
    few = F.element_at(F.array(*[F.lit(student_quantile(p, d)) for d in range(1, STUDENT + 1)]), F.greatest(F.least(df, F.lit(STUDENT)), F.lit(1)).cast("int"))
    return F.when(df < 1, None).when(df <= STUDENT, few).otherwise(series)


def percentile(c: str | Column, p: float) -> Column:
    """The exact quantile, linear between neighbours."""
    return F.percentile(c, F.lit(p))


def seed_summary(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean, sd (0 for one value), median, 2.5 and 97.5 % quantiles, least and largest."""
    return values.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), percentile(value, 0.5).alias("median"),
        percentile(value, 0.025).alias("low"), percentile(value, 0.975).alias("high"), F.min(value).alias("least"), F.max(value).alias("largest"),
    )


def t_interval(values: DataFrame, by: Sequence[str], value: str = "value", confidence: float = 0.95) -> DataFrame:
    """n, mean, sd and the mean's interval by Student's t; sd, low and high are null where there is but one value."""
    out = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = student_column(F.col("n") - 1, confidence) * F.col("sd") / F.sqrt(F.col("n"))
    return out.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def paired(base: DataFrame, other: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, delta = other - base) of runs that both sides have."""
    return base.select(*keys, F.col(value).alias("_a")).join(other.select(*keys, F.col(value).alias("_b")), list(keys)).select(*keys, (F.col("_b") - F.col("_a")).alias("delta"))


def delta_summary(deltas: DataFrame, by: Sequence[str]) -> DataFrame:
    return deltas.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.min("delta").alias("least"), F.max("delta").alias("largest"),
        F.count_if(F.col("delta") < 0).alias("n_negative"), F.count_if(F.col("delta") > 0).alias("n_positive"), F.bool_and(F.col("delta") < 0).alias("all_negative"),
    )


def matched_null(observed: DataFrame, null: DataFrame, keys: Sequence[str], larger_is_better: bool = True) -> DataFrame:
    """Observed drops against those of random removals: quantiles of the null, ties, and p = (1 + as extreme) / (n + 1).

    Columns baseline and value in `observed`, value in `null`; the drop is value - baseline,
    and as extreme means at least as bad.
    """
    joined = null.select(*keys, F.col("value").alias("_v")).join(observed.select(*keys, "baseline", (F.col("value") - F.col("baseline")).alias("observed_delta")), list(keys))
    deltas = joined.withColumn("_d", F.col("_v") - F.col("baseline"))
    extreme = F.col("_d") <= F.col("observed_delta") if larger_is_better else F.col("_d") >= F.col("observed_delta")
    return deltas.groupBy(*keys, "observed_delta").agg(
        F.count("*").alias("n_null"), F.avg("_d").alias("null_mean"), percentile("_d", 0.025).alias("null_low"), percentile("_d", 0.975).alias("null_high"),
        F.count_if(F.col("_d") == F.col("observed_delta")).alias("n_ties"), ((1 + F.count_if(extreme)) / (F.count("*") + 1)).alias("p_value"),
    )


def _scores(cells: np.ndarray, labels: int) -> dict[str, np.ndarray]:
    """Metrics of confusion matrices (replicates, labels * labels); a label without a true row has a recall of 0."""
    m = cells.reshape(len(cells), labels, labels)
    support, predicted, hits = m.sum(2), m.sum(1), np.einsum("rii->ri", m)
    with np.errstate(divide="ignore", invalid="ignore"):
        recall, precision = np.where(support > 0, hits / support, 0.0), np.where(predicted > 0, hits / predicted, 0.0)
        f1 = np.where(support + predicted > 0, 2 * hits / (support + predicted), 0.0)
        return {"accuracy": hits.sum(1) / m.sum((1, 2)), "balanced_accuracy": recall.mean(1), "macro_f1": f1.mean(1), "macro_precision": precision.mean(1)}


def cluster_bootstrap(predictions: DataFrame, cluster: str, by: str, replicates: int = 500, seed: int = 0) -> DataFrame:
    """(by, metric, estimate, low, median, high): clusters are drawn with replacement and bring all their members.

    Confusion cells are additive, so clusters with equal cells are alike: what goes to
    the resampling is one row for each distinct contribution with the number of its
    clusters, and a replicate draws a multinomial count for each.
    """
    cells = predictions.groupBy(by, cluster, "y_true", "y_pred").agg(F.count("*").alias("n"))
    shape = F.array_sort(F.collect_list(F.struct("y_true", "y_pred", "n")))
    kinds = cells.groupBy(by, cluster).agg(shape.alias("cells")).groupBy(by, "cells").agg(F.count("*").alias("clusters"))
    kind = dict(predictions.dtypes)[by]

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(key=[str([(c["y_true"], c["y_pred"], c["n"]) for c in x]) for x in part["cells"]]).sort_values("key")
        labels = sorted({c[k] for x in part["cells"] for c in x for k in ("y_true", "y_pred")})
        at = {x: i for i, x in enumerate(labels)}
        rows = np.zeros((len(part), len(labels) ** 2))
        for i, x in enumerate(part["cells"]):
            for c in x:
                rows[i, at[c["y_true"]] * len(labels) + at[c["y_pred"]]] += c["n"]
        counts = part["clusters"].to_numpy()
        drawn = np.random.default_rng(seed).multinomial(counts.sum(), counts / counts.sum(), size=replicates)
        own, many = _scores((counts @ rows)[None], len(labels)), _scores(drawn @ rows, len(labels))
        return pd.DataFrame([{by: part[by].iloc[0], "metric": m, "estimate": float(own[m][0]), "low": float(np.nanquantile(v, 0.025)), "median": float(np.nanquantile(v, 0.5)), "high": float(np.nanquantile(v, 0.975))} for m, v in many.items()])

    return kinds.groupBy(by).applyInPandas(draw, f"{by} {kind}, metric string, estimate double, low double, median double, high double")


def bootstrap_mean(values: DataFrame, by: str, value: str, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """(by, n, mean, low, high) of the mean over runs; runs of a group are few (seeds)."""
    kind = dict(values.dtypes)[by]

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(part[value].to_numpy(float))
        rng, means = np.random.default_rng(seed), []
        for at in range(0, replicates, 1000):
            means.append(x[rng.integers(0, len(x), (min(1000, replicates - at), len(x)))].mean(1))
        low, high = np.quantile(np.concatenate(means), [0.025, 0.975])
        return pd.DataFrame({by: [part[by].iloc[0]], "n": [len(x)], "mean": [x.mean()], "low": [low], "high": [high]})

    return values.groupBy(by).applyInPandas(draw, f"{by} {kind}, n long, mean double, low double, high double")


def paired_cluster_bootstrap(contributions: DataFrame, cluster: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(estimate, low, high) of the difference of accuracies of two runs; both sides of a replicate hold the same clusters.

    contributions: cluster, n, hits_a, hits_b. Clusters with equal contributions are one row.
    """
    kinds = contributions.groupBy(cluster).agg(F.sum("n").alias("n"), F.sum("hits_a").alias("a"), F.sum("hits_b").alias("b")).groupBy("n", "a", "b").agg(F.count("*").alias("clusters"))

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "a", "b"])
        counts = part["clusters"].to_numpy()
        drawn = np.random.default_rng(seed).multinomial(counts.sum(), counts / counts.sum(), size=replicates)
        n, a, b = (drawn @ part[c].to_numpy(float) for c in ("n", "a", "b"))
        total = (counts * part["n"]).sum()
        low, high = np.quantile((b - a) / n, [0.025, 0.975])
        return pd.DataFrame({"n_clusters": [int(counts.sum())], "estimate": [float((counts * (part["b"] - part["a"])).sum() / total)], "low": [low], "high": [high]})

    return kinds.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(draw, "n_clusters long, estimate double, low double, high double")


def effective_size(weights: Column) -> Column:
    """Aggregate: (sum of weights) squared over the sum of squares."""
    return F.sum(weights) * F.sum(weights) / F.sum(weights * weights)


def normal_quantile_half(p: float) -> float:
    """z for a two-sided interval, by bisection on erf."""
    low, high = 0.0, 10.0
    for _ in range(80):
        z = (low + high) / 2
        low, high = (z, high) if math.erf(z / math.sqrt(2)) < p else (low, z)
    return (low + high) / 2
