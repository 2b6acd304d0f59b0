"""Sessions, crossover designs, session costs, model grids and synthetic notes, from hashed draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A draw in (0, 1) that depends on the keys and seed alone, so reruns and retries agree."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(2**31 - 1)) + 0.5) / (2**31 - 1)


def normal(*keys: Column, seed: int = 0) -> Column:
    return F.sqrt(-2 * F.log(uniform(*keys, seed=seed))) * F.cos(F.lit(2 * math.pi) * uniform(*keys, seed=seed + 1))


def crossover(subjects: DataFrame, subject: str, arms: list[str], key: Column | None = None, seed: int = 42) -> DataFrame:
    """subject, arm, period: each subject meets every arm once, in the order of a hash (or ``key``)."""
    crossed = subjects.select(subject, F.explode(F.array(*map(F.lit, arms))).alias("arm"))
    order = F.xxhash64(F.col(subject), F.col("arm"), F.lit(seed)) if key is None else key
    return crossed.withColumn("period", F.row_number().over(Window.partitionBy(subject).orderBy(order, "arm")))


def session_cost(turns: DataFrame, keys: list[str], order: str, found: str, latency: str, dwell: str, cap: float = 300.0) -> DataFrame:
    """keys, n_turns, n_found, seconds: time until the last success if all turns succeed, else 45 s more for each miss, capped.

    A turn takes 35 s, its dwell and its latency, or when it succeeds 8 s, its latency and 0.3 of its dwell.
    """
    cost = F.when(F.col(found), F.col(latency) + F.col(dwell) * 0.3 + 8).otherwise(F.col(latency) + F.col(dwell) + 35)
    running = turns.withColumn("__at", F.sum(cost).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    out = running.groupBy(*keys).agg(F.count("*").alias("n_turns"), F.count_if(F.col(found)).alias("n_found"), F.max("__at").alias("whole"), F.max(F.when(F.col(found), F.col("__at"))).alias("last_found"))
    missing = F.col("n_turns") - F.col("n_found")
    return out.select(*keys, "n_turns", "n_found", F.least(F.when(missing == 0, F.col("last_found")).otherwise(F.col("whole") + missing * 45), F.lit(cap)).alias("seconds"))


def pivots(turns: DataFrame, session: str, order: str, topic: str) -> DataFrame:
    """Adds pivot: the topic differs from the turn's before."""
    before = F.lag(topic).over(Window.partitionBy(session).orderBy(order))
    return turns.withColumn("pivot", F.coalesce(F.col(topic) != before, F.lit(False)))


def sessions(notes: DataFrame, patient: str, note: str, topic: str, least_notes: int = 8, targets: int = 5, many_pivots: int = 2, seed: int = 42) -> DataFrame:
    """patient, n_queries, pivots, complexity, targets: sessions over hashed target notes of patients with enough notes."""
    sized = notes.withColumn("__n", F.count("*").over(Window.partitionBy(patient))).where(F.col("__n") >= least_notes)
    chosen = sized.withColumn("turn", F.row_number().over(Window.partitionBy(patient).orderBy(F.xxhash64(note, F.lit(seed)), note)) - 1)
    count = (F.pmod(F.xxhash64(F.col(patient), F.lit(seed + 1)), F.lit(targets)) + 1).cast("int")
    marked = pivots(chosen.where(F.col("turn") < count), patient, "turn", topic)
    held = marked.groupBy(patient).agg(F.array_sort(F.collect_list(F.struct("turn", F.col(note).alias("note"), F.col("pivot").alias("pivot")))).alias("t"))
    out = held.select(patient, F.size("t").alias("n_queries"), F.transform(F.filter("t", lambda x: x["pivot"]), lambda x: x["turn"]).alias("pivots"), F.transform("t", lambda x: x["note"]).alias("targets"))
    return out.withColumn("complexity", F.when((F.size("pivots") >= many_pivots) | (F.col("n_queries") >= 4), F.lit("high")).otherwise(F.lit("low")))


def model_grid(spark: SparkSession, temperatures: list[float], sulphur: bool = True) -> DataFrame:
    """T_eq, log_H2O, log_SO2 of every combination: three water amounts, and sulphur dioxide absent or present."""
    t = spark.createDataFrame([(float(x),) for x in temperatures], "T_eq double")
    water = spark.createDataFrame([(-4.0,), (-3.5,), (-3.0,)], "log_H2O double")
    so2 = spark.createDataFrame([(-10.0,), (-5.5,)] if sulphur else [(-10.0,)], "log_SO2 double")
    return t.crossJoin(water).crossJoin(so2)


TEMPLATES = ["Patient seen for {d}. Course discussed and plan agreed.", "Follow-up of {d}: symptoms reviewed, treatment continued.", "Consultation on {d} with findings recorded for the team."]


def synthetic_notes(spark: SparkSession, patients: int, diagnoses: list[str], seed: int = 42, first: int = 0) -> DataFrame:
    """Notes of made-up patients: 4 to 12 each, one in five off the patient's diagnosis."""
    people = spark.range(first, first + patients).select(F.col("id").alias("p"))
    count = (F.floor(uniform(F.col("p"), seed=seed) * 9) + 4).cast("int")
    rows = people.select("p", F.explode(F.sequence(F.lit(1), count)).alias("k"))
    names = F.array(*map(F.lit, diagnoses))
    pick = lambda u: F.get(names, F.floor(u * len(diagnoses)).cast("int"))
    own = pick(uniform(F.col("p"), seed=seed + 2))
    other = pick(uniform(F.col("p"), F.col("k"), seed=seed + 4))
    drawn = rows.select("p", "k", own.alias("primary_diagnosis"), F.when(uniform(F.col("p"), F.col("k"), seed=seed + 6) < 0.2, other).otherwise(own).alias("diagnosis"))
    template = F.get(F.array(*map(F.lit, TEMPLATES)), F.floor(uniform(F.col("p"), F.col("k"), seed=seed + 8) * len(TEMPLATES)).cast("int"))
    return drawn.select(F.format_string("P%06d", "p").alias("patient_id"), F.format_string("N%06d_%02d", "p", "k").alias("note_id"), "primary_diagnosis", "diagnosis", F.replace(template, F.lit("{d}"), F.col("diagnosis")).alias("text"))


def padded_patients(notes: DataFrame, target: int, diagnoses: list[str]) -> DataFrame:
    """``notes`` with synthetic patients added up to ``target`` distinct ones."""
    have = notes.agg(F.countDistinct("patient_id")).first()[0]
    made = synthetic_notes(notes.sparkSession, max(0, target - have), diagnoses, first=900_000)
    return notes.unionByName(made, allowMissingColumns=True)


def synthetic_spectra(params: DataFrame, key: str, low: float, high: float, points: int, noise: float, seed: int = 42) -> DataFrame:
    """key, wavelengths, depths, uncertainties from the forward model with hashed noise. params: key and a map ``params``."""
    from skein.functions.spectra import forward_model

    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * (high - low) / (points - 1))
    based = params.withColumn("wavelengths", grid)
    model = based.withColumn("__m", forward_model(F.col("wavelengths"), F.col("params")))
    return model.select(key, "params", "wavelengths", F.transform("__m", lambda d, i: d + normal(F.col(key), i, seed=seed) * noise).alias("depths"), F.transform("__m", lambda d: F.lit(noise)).alias("uncertainties"))
