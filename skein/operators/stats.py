"""Arm summaries, paired tests and evaluation metrics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import percent_change


def arm_summary(frame: DataFrame, arm: str, metrics: list[str]) -> DataFrame:
    """arm, n and for each metric its mean and standard error."""
    parts = []
    for m in metrics:
        parts += [F.avg(m).alias(f"{m}_mean"), (F.stddev_samp(m) / F.sqrt(F.count(m))).alias(f"{m}_se")]
    return frame.groupBy(arm).agg(F.count("*").alias("n"), *parts)


def outcome_summary(frame: DataFrame, arm: str, outcome: str, control: str) -> DataFrame:
    """arm, mean, median, sd and the change of mean against the control arm in percent."""
    own = frame.groupBy(arm).agg(F.avg(outcome).alias("mean"), F.percentile(outcome, F.lit(0.5)).alias("median"), F.stddev_samp(outcome).alias("sd"))
    base = own.where(F.col(arm) == control).select(F.col("mean").alias("base"))
    return own.join(F.broadcast(base)).select(arm, "mean", "median", "sd", percent_change(F.col("mean"), F.col("base"), 6).alias("pct_change"))


def change_against_control(frame: DataFrame, arm: str, metrics: list[str], control: str, keys: list[str] | None = None) -> DataFrame:
    """keys, arm, metric, value, pct_change; arms whose control value is zero are left out."""
    keys = keys or []
    long = frame.groupBy(*keys, arm).agg(*(F.avg(m).alias(m) for m in metrics)).unpivot([*keys, arm], metrics, "metric", "value")
    base = long.where(F.col(arm) == control).select(*keys, "metric", F.col("value").alias("base"))
    met = long.join(base, [*keys, "metric"]).where("base != 0")
    return met.select(*keys, arm, "metric", "value", percent_change(F.col("value"), F.col("base"), 6).alias("pct_change"))


def two_key_means(frame: DataFrame, rows: str, columns: str, names: list, value: str) -> DataFrame:
    return frame.groupBy(rows).pivot(columns, names).agg(F.avg(value))


def finite_summary(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mean, sd (population) and median over finite values; null if there are none."""
    finite = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    held = frame.withColumn("__v", finite)
    return held.groupBy(*keys).agg(F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("sd"), F.percentile("__v", F.lit(0.5)).alias("median"), F.count("__v").alias("n"))


def value_shares(frame: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, n, share of the group."""
    counts = frame.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def paired(frame: DataFrame, subject: str, arm: str, value: str, a: str, b: str) -> DataFrame:
    """subject, a, b for subjects that have both arms."""
    wide = frame.where(F.col(arm).isin(a, b)).groupBy(subject).agg(F.avg(F.when(F.col(arm) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(arm) == b, F.col(value))).alias("b"))
    return wide.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def paired_stats(pairs: DataFrame) -> DataFrame:
    """n, w_plus, w_minus, p_value, mean_diff, median_diff, cohens_d over all pairs (b - a).

    Signed ranks give tied differences their mean rank and split the ranks of zeros between the signs. Ranks
    come from counts of distinct differences, so the one ordered window is over distinct sizes. Fewer than
    three pairs give nulls.
    """
    diffs = pairs.select((F.col("b") - F.col("a")).alias("d"))
    sizes = diffs.groupBy(F.round(F.abs("d"), 9).alias("size")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("plus"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("minus"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", before + (F.col("n") + 1) / 2)
    zero = F.col("size") == 0
    half = F.when(zero, F.col("n") * F.col("rank") / 2).otherwise(F.lit(0.0))
    tie = F.when(zero, F.lit(0)).otherwise(F.pow(F.col("n"), F.lit(3)) - F.col("n"))
    sums = ranked.agg(
        F.sum(F.when(zero, F.lit(0.0)).otherwise(F.col("plus") * F.col("rank")) + half).alias("w_plus"),
        F.sum(F.when(zero, F.lit(0.0)).otherwise(F.col("minus") * F.col("rank")) + half).alias("w_minus"),
        F.sum(tie).alias("ties"),
        F.coalesce(F.sum(F.when(zero, F.col("n"))), F.lit(0)).alias("zeros"),
    )
    moments = diffs.agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.percentile("d", F.lit(0.5)).alias("median_diff"), F.stddev_samp("d").alias("sd"))
    n, z = F.col("n").cast("double"), F.col("zeros").cast("double")
    variance = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1)) / 24 - F.col("ties") / 48
    centre = F.least("w_plus", "w_minus") - (n * (n + 1) - z * (z + 1)) / 4 - z * (z + 1) / 4

    enough = F.col("n") >= 3
    joined = moments.join(F.broadcast(sums))
    out = joined.withColumn("p_value", normal_two_sided(F.when(variance > 0, centre / F.sqrt(variance)).otherwise(F.lit(0.0))))
    effect = F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("sd")).otherwise(F.lit(0.0))
    return out.select("n", *(F.when(enough, F.col(c)).alias(c) for c in ("w_plus", "w_minus", "p_value", "mean_diff", "median_diff")), F.when(enough, effect).alias("cohens_d"))


def normal_two_sided(z: Column) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else None)

    return tail(z)


def chi2_one_tail(statistic: Column) -> Column:
    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v else None)

    return tail(statistic)


def mcnemar(pairs: DataFrame) -> DataFrame:
    """both, only_a, only_b, neither, statistic (with continuity correction). pairs: boolean a and b."""
    a, b = F.col("a"), F.col("b")
    counts = pairs.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))
    split = F.col("only_a") + F.col("only_b")
    return counts.withColumn("statistic", F.when(split > 0, F.pow(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(2)) / split).otherwise(F.lit(0.0)))


def subgroup_effects(pairs: DataFrame, group: str, least_pairs: int = 3) -> DataFrame:
    """group, n, mean, median, low, high of the percent change from a to b."""
    change = pairs.where("a != 0").withColumn("pct", (F.col("b") - F.col("a")) / F.col("a") * 100)
    out = change.groupBy(group).agg(F.count("*").alias("n"), F.avg("pct").alias("mean"), F.percentile("pct", F.lit(0.5)).alias("median"), F.percentile("pct", F.lit(0.025)).alias("low"), F.percentile("pct", F.lit(0.975)).alias("high"))
    return out.where(F.col("n") >= least_pairs)


def one_hot(frame: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Adds a 0/1 column for each value but the first in order."""
    return frame.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in sorted(values)[1:]})


def min_max(frame: DataFrame, column: str, keys: list[str], cap: float | None = None, flip: bool = False) -> Column:
    """``column`` scaled to 0..1 within keys, flipped where less is better, one half where flat."""
    w = Window.partitionBy(*keys)
    x = F.least(F.col(column), F.lit(cap)) if cap is not None else F.col(column)
    low, high = F.min(x).over(w), F.max(x).over(w)
    scaled = (x - low) / (high - low)
    return F.when(high == low, F.lit(0.5)).otherwise(1 - scaled if flip else scaled)


def retrieval_metrics(results: DataFrame, penalty: float = 300.0) -> DataFrame:
    """n, ttci, mrr, contextual_precision. results: retrieved and relevant arrays, active array, target, seconds."""
    rank = F.array_position("retrieved", F.col("target"))
    active = F.array_distinct("active")
    precision = F.when(F.size(active) > 0, F.size(F.array_intersect(active, F.col("relevant"))) / F.size(active))
    return results.agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.when(rank > 0, F.col("seconds")).otherwise(F.lit(penalty))), F.lit(0.0)).alias("ttci"),
        F.coalesce(F.avg(F.when(rank > 0, 1 / rank).otherwise(F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(precision), F.lit(0.0)).alias("contextual_precision"),
    )


def band_f1(predicted: DataFrame, truth: DataFrame, keys: list[str], tolerance: int = 1) -> DataFrame:
    """precision, recall, f1 of predicted steps against true ones within ``tolerance``.

    The band is an equality on steps shifted by each offset, so both sides meet in hash joins.
    """
    offsets = F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance)))

    def spread(side: DataFrame) -> DataFrame:
        return side.select(*keys, "step", offsets.alias("o")).select(*keys, (F.col("step") + F.col("o")).alias("step")).distinct()

    hit_p = predicted.join(spread(truth), [*keys, "step"], "left_semi").agg(F.count("*").alias("hit_p"))
    hit_t = truth.join(spread(predicted), [*keys, "step"], "left_semi").agg(F.count("*").alias("hit_t"))
    sizes = predicted.agg(F.count("*").alias("n_p")).join(truth.agg(F.count("*").alias("n_t")))
    met = sizes.join(hit_p).join(hit_t)
    p = F.when(F.col("n_p") > 0, F.col("hit_p") / F.col("n_p")).otherwise(F.lit(0.0))
    r = F.when(F.col("n_t") > 0, F.col("hit_t") / F.col("n_t")).otherwise(F.lit(0.0))
    return met.select(p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))


def residual_contamination(a: Column, b: Column) -> Column:
    """Absolute cosine of two mean vectors."""
    from skein.functions.vectors import cosine

    return F.abs(cosine(a, b))


def final_accuracy(estimate: Column, reference: Column) -> Column:
    """1 less the relative distance, within 0..1."""
    from skein.functions.vectors import distance, norm

    return F.least(F.greatest(F.lit(1.0) - distance(estimate, reference) / F.greatest(norm(reference), F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))


def contested(frame: DataFrame, keys: list[str], arm: str, a: str, b: str, fields: list[str]) -> DataFrame:
    """keys, field, value_a, value_b where two arms differ."""
    long = frame.select(*keys, arm, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot([*keys, arm], fields, "field", "value")
    left = long.where(F.col(arm) == a).select(*keys, "field", F.col("value").alias("value_a"))
    right = long.where(F.col(arm) == b).select(*keys, "field", F.col("value").alias("value_b"))
    return left.join(right, [*keys, "field"]).where(~F.col("value_a").eqNullSafe(F.col("value_b")))


def apply_adjudications(results: DataFrame, decisions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``results`` with each field replaced, in all arms of a key, by the last decision on it (columns key, field, value, at)."""
    last = decisions.groupBy(key, "field").agg(F.max_by("value", "at").alias("value"))
    wide = last.groupBy(key).pivot("field", fields).agg(F.first("value"))
    renamed = wide.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    joined = results.join(renamed, key, "left")
    kinds = {f.name: f.dataType.simpleString() for f in results.schema}
    return joined.select(*(F.coalesce(F.expr(f"try_cast(`__{c}` AS {kinds[c]})"), F.col(c)).alias(c) if c in fields else F.col(c) for c in results.columns))


def merge_annotations(results: DataFrame, annotations: DataFrame, keys: tuple[str, str] = ("vignette_id", "condition")) -> DataFrame:
    return results.join(annotations, list(keys), "left")
