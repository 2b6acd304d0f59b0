"""Column expressions over array vectors, edge weights and scores. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trust in, and cost of, each of five modalities.
GAMMA = {"spectral": 1.0, "photometric": 0.9, "imaging": 0.8, "model": 0.7, "literature": 0.5}
COST = {"spectral": 1.0, "photometric": 0.5, "imaging": 1.5, "model": 0.3, "literature": 0.05}
SECONDS_A_YEAR = 3.15e7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """``a`` as doubles of length one; a zero vector stays zero."""
    return let(F.struct(F.transform(a, lambda x: x.cast("double")).alias("a"), norm(a).alias("n")), lambda v: F.transform(v["a"], lambda x: F.when(v["n"] > 0, x / v["n"]).otherwise(F.lit(0.0))))


def cosine(a: Column | str, b: Column | str, least_norm: float = 1e-9) -> Column:
    na, nb = norm(a), norm(b)
    return F.when((na < least_norm) | (nb < least_norm), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def temporal_decay(ti: Column, tj: Column, sigma: float = 3.0) -> Column:
    return F.exp(-F.abs(ti - tj) / F.lit(sigma))


def composite_weight(ti: Column, tj: Column, a: Column | str, b: Column | str, alpha: float = 0.5, sigma: float = 3.0) -> Column:
    return F.lit(alpha) * temporal_decay(ti, tj, sigma) + F.lit(1 - alpha) * cosine(a, b)


def cross_modality_weight(a: Column | str, b: Column | str, threshold: float = 0.35) -> Column:
    c = cosine(a, b, 1e-12)
    return F.when(c >= threshold, c).otherwise(F.lit(0.0))


def spectro_physical_weight(a: Column | str, b: Column | str, chi2: Column, quality_a: Column, quality_b: Column) -> Column:
    return F.greatest(F.exp(-F.coalesce(chi2, F.lit(2.0))) * cosine(a, b, 1e-12) * quality_a * quality_b, F.lit(0.0))


def literature_weight(a: Column | str, b: Column | str, now: Column, published: Column, beta: float = 0.5, years: float = 2.0) -> Column:
    recency = F.exp(-F.abs(now - published) / F.lit(years * SECONDS_A_YEAR))
    return cosine(a, b, 1e-12) * (F.lit(beta) + F.lit(1 - beta) * recency)


def literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def gamma_of(modality: Column) -> Column:
    return F.element_at(literal_map(GAMMA), modality)


def cost_of(modality: Column) -> Column:
    return F.element_at(literal_map(COST), modality)


def node_cost(mean_cosine: Column, most: float = 7.0) -> Column:
    """Surprise of a node given the active context's mean cosine; no context costs the most."""
    clipped = F.least(F.greatest(mean_cosine, F.lit(1e-6)), F.lit(1.0))
    return F.coalesce(F.least(F.greatest(-F.log(clipped), F.lit(0.0)), F.lit(most)), F.lit(most))


def information_gain(cosines: Column | str, squared_vector: Column | str, lambda2: Column) -> Column:
    """Sum of squared positive cosines weighted by the squared connectivity vector, over lambda2."""
    terms = F.zip_with(cosines, squared_vector, lambda c, v: F.pow(F.greatest(c, F.lit(0.0)), F.lit(2)) * v)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / F.greatest(lambda2, F.lit(1e-4))


def gain_weight(gain: Column, beta: float = 2.0) -> Column:
    return F.exp(F.lit(beta) * gain) * gain


def contamination_bound(tau: Column, delta: Column) -> Column:
    return F.when(delta <= 0, F.lit(1.0)).otherwise(F.lit(0.08) * F.sqrt(tau / delta))


def capped_contamination_bound(tau: Column, delta: Column) -> Column:
    return F.lit(0.08) * F.sqrt(F.least(tau / F.greatest(F.abs(delta), F.lit(1e-4)), F.lit(1.0)))


def percent_change(value: Column, base: Column, digits: int = 2) -> Column:
    return F.when(base.isNotNull() & (base != 0), F.round(F.lit(100.0) * (value - base) / base, digits))


def keyword_score(tokens: Column | str, terms: list[str], k1: float = 1.5, b: float = 0.75, mean_length: float = 20.0) -> Column:
    """Okapi-like score whose rarity factor comes from the term's count in the text itself."""
    length = F.size(tokens).cast("double")
    total = F.lit(0.0)
    for term in terms:
        tf = F.size(_occurrences(tokens, term)).cast("double")
        idf = F.log(F.lit(1.0) + F.lit(1.0) / (tf + 0.5))
        total = total + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))).otherwise(F.lit(0.0))
    return total


def _occurrences(tokens: Column | str, term: str) -> Column:
    return F.filter(tokens, lambda t: t == term)


def substring_count(text: Column, term: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def literature_features(text: Column, terms: list[str], width: int = 64) -> Column:
    """Counts of each term as a substring, padded to ``width`` and scaled to length one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = F.array(*(substring_count(low, t).cast("double") for t in terms[:width]), *(F.lit(0.0) for _ in range(width - len(terms))))
    return unit(counts)


def z_score(value: Column, window) -> Column:
    """Standardised over the window; only centred where the population deviation vanishes."""
    mean, spread = F.avg(value).over(window), F.stddev_pop(value).over(window)
    return F.when(spread < 1e-12, value - mean).otherwise((value - mean) / spread)
