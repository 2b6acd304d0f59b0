"""Regressions on paired or clustered sessions, from sums that Spark makes; only those come to the driver."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import stats

MOST_PATTERNS = 100_000


def design(frame: DataFrame, arm: str, arms: tuple[str, str], numbers: list[str], categories: list[str]) -> tuple[list[Column], list[str]]:
    """Columns of a design matrix with their names: a constant, the second arm, numbers, and categories without their first value."""
    columns, names = [F.lit(1.0), (F.col(arm) == arms[1]).cast("double")], ["const", arms[1]]
    for n in numbers:
        columns.append(F.col(n).cast("double"))
        names.append(n)
    for c in categories:
        values = sorted(r[0] for r in frame.select(c).where(F.col(c).isNotNull()).distinct().limit(1001).collect())
        if len(values) > 1000:
            raise ValueError(f"more than 1000 values of {c}")
        for v in values[1:]:
            columns.append((F.col(c) == v).cast("double"))
            names.append(f"{c}={v}")
    return columns, names


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def random_intercept(frame: DataFrame, group: str, outcome: Column, columns: list[Column], names: list[str]) -> list[dict]:
    """Fixed effects of a linear model with a random intercept for each group, by maximum likelihood: name, estimate, error, p_value.

    The likelihood needs sums over rows, and over groups of one size sums of products of the groups' own sums:
    one row for each size of group reaches the driver. The ratio of variances is searched on a line.
    """
    p = len(columns)
    both = [*columns, outcome.cast("double")]
    rows = frame.where(outcome.isNotNull()).select(F.col(group).alias("g"), *(c.alias(f"c{k}") for k, c in enumerate(both)))
    pairs = [(a, b) for a in range(p + 1) for b in range(a + 1)]
    own = rows.groupBy("g").agg(F.count("*").alias("n"), *(F.sum(f"c{k}").alias(f"s{k}") for k in range(p + 1)), *(F.sum(F.col(f"c{a}") * F.col(f"c{b}")).alias(f"q{a}_{b}") for a, b in pairs))
    made = own.groupBy("n").agg(F.count("*").alias("m"), *(F.sum(f"q{a}_{b}") for a, b in pairs), *(F.sum(F.col(f"s{a}") * F.col(f"s{b}")) for a, b in pairs)).collect()
    lower = np.tril_indices(p + 1)

    def square(values: tuple) -> np.ndarray:
        m = np.zeros((p + 1, p + 1))
        m[lower] = values
        return m + np.tril(m, -1).T

    parts = [(r[0], r[1], square(r[2 : 2 + len(pairs)]), square(r[2 + len(pairs) :])) for r in made]
    total = sum(n * m for n, m, _, _ in parts)

    def fitted(ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        w = sum(q - ratio / (1 + n * ratio) * s for n, _, q, s in parts)
        inverse = np.linalg.pinv(w[:p, :p])
        beta = inverse @ w[:p, p]
        variance = (w[p, p] - beta @ w[:p, p]) / total
        logdet = sum(m * math.log1p(n * ratio) for n, m, _, _ in parts)
        return -0.5 * (total * math.log(max(variance, 1e-300)) + logdet), beta, inverse, variance

    low, high, golden = -12.0, 8.0, (math.sqrt(5) - 1) / 2
    while high - low > 1e-7:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if fitted(math.exp(a))[0] >= fitted(math.exp(b))[0] else (a, high)
    best = max((0.0, math.exp((low + high) / 2)), key=lambda r: fitted(r)[0])
    _, beta, inverse, variance = fitted(best)
    errors = np.sqrt(np.maximum(np.diag(inverse) * variance, 0))
    return [{"name": n, "estimate": float(b), "error": float(e), "p_value": two_sided(b / e) if e > 0 else float("nan")} for n, b, e in zip(names, beta, errors, strict=True)]


def clustered_logistic(frame: DataFrame, cluster: str, outcome: Column, columns: list[Column], names: list[str], rounds: int = 60, tolerance: float = 1e-8) -> list[dict]:
    """Logistic regression by estimating equations with exchangeable correlation and robust errors: name, odds_ratio, estimate, error, p_value, converged.

    Clusters that hold the same rows count once with their number, so the patterns that reach the driver are
    as many as there are combinations of covariates; their number is checked.
    """
    row = F.struct(*(c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)), outcome.cast("double").alias("y"))
    held = frame.where(outcome.isNotNull()).groupBy(F.col(cluster).alias("g")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    found = held.groupBy("rows").agg(F.count("*").alias("m")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} different clusters; use fewer or coarser covariates")
    patterns = [(np.array([list(x)[:-1] for x in r.rows]), np.array([x.y for x in r.rows]), r.m) for r in found]
    p, alpha, beta, converged = len(columns), 0.0, np.zeros(len(columns)), False
    share = sum(m * y.sum() for _, y, m in patterns) / sum(m * len(y) for _, y, m in patterns)
    if 0 < share < 1:
        beta[0] = math.log(share / (1 - share))

    def equations() -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        bread, push, meat, pairs, count, squares, n = np.zeros((p, p)), np.zeros(p), np.zeros((p, p)), 0.0, 0, 0.0, 0
        for x, y, m in patterns:
            mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            root = np.sqrt(mu * (1 - mu))
            r = (y - mu) / root
            size = len(y)
            scaled = x * root[:, None]
            inverse = (np.eye(size) - alpha / (1 + (size - 1) * alpha)) / (1 - alpha)
            g = scaled.T @ inverse @ r
            bread += m * scaled.T @ inverse @ scaled
            push += m * g
            meat += m * np.outer(g, g)
            squares, n = squares + m * (r @ r), n + m * size
            pairs, count = pairs + m * (r.sum() ** 2 - r @ r) / 2, count + m * size * (size - 1) // 2
        phi = squares / max(n - p, 1)
        return bread, push, meat, float(np.clip(pairs / max(count - p, 1) / phi, -0.9, 0.99)) if count else 0.0

    for _ in range(rounds):
        bread, push, _, correlation = equations()
        step = np.linalg.pinv(bread) @ push
        beta = beta + step
        converged = bool(np.abs(step).max() < tolerance and abs(correlation - alpha) < 1e-6)
        alpha = correlation
        if converged:
            break
    bread, _, meat, _ = equations()
    inverse = np.linalg.pinv(bread)
    errors = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
    return [{"name": n, "odds_ratio": math.exp(b), "estimate": float(b), "error": float(e), "p_value": two_sided(b / e) if e > 0 else float("nan"), "converged": converged} for n, b, e in zip(names, beta, errors, strict=True)]


def against_benchmarks(frame: DataFrame, subject: str, arm: str, target: str, benchmarks: list[str], outcomes: list[str]) -> DataFrame:
    """outcome, benchmark, n, w_plus, w_minus, p_value, mean_diff, median_diff, cohens_d and both changes in percent of the benchmark's median."""
    parts = []
    for outcome in outcomes:
        for benchmark in benchmarks:
            found = stats.paired_stats(stats.paired(frame, subject, arm, outcome, benchmark, target))
            base = frame.where(F.col(arm) == benchmark).agg(F.percentile(outcome, F.lit(0.5)).alias("base"))
            change = lambda c: F.when(F.col("base") > 0, F.round(100 * F.col(c) / F.col("base"), 2))
            parts.append(found.join(F.broadcast(base)).select(F.lit(outcome).alias("outcome"), F.lit(benchmark).alias("benchmark"), *found.columns, change("median_diff").alias("median_pct_change"), change("mean_diff").alias("mean_pct_change")))
    return reduce(DataFrame.unionByName, parts)


def ablation_summary(frame: DataFrame, variant: str, arm: str, metrics: list[str], control: str) -> tuple[DataFrame, DataFrame]:
    """Means by variant and arm; and for each variant the change of each metric against its control arm in percent."""
    means = frame.groupBy(variant, arm).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))
    changes = stats.change_against_control(frame, arm, metrics, control, [variant])
    return means, changes.where(F.col(arm) != control)
