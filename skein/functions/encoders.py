"""Encoders to one width: spectra, light curves, model parameters, literature and waveforms. Columns, but for the waveforms.

``ENCODERS`` names them, :func:`register_encoder` adds others, and :func:`register_functions` gives SQL a table function.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skein.functions.spectra import correlation, cosine_transform, mean, spread
from skein.functions.vectors import let, norm, substring_count

WIDTH = 64
# Wavelength bins of a spectrum's mean depths, in micrometres.
FEATURE_BINS = [(0.5, 1.0), (1.0, 1.5), (1.5, 2.0), (2.0, 2.5), (2.5, 3.5), (3.5, 4.5), (4.5, 6.0), (6.0, 8.5), (8.5, 12.0), (0.5, 12.0)]
# Model parameters with the means and deviations that standardise them.
MODEL_PARAMETERS = [("T_eq", 1000.0, 400.0), ("log_g", 3.0, 0.5), ("log_H2O", -3.0, 1.5), ("log_CO2", -3.5, 1.5), ("log_SO2", -7.0, 2.5), ("log_CO", -3.5, 1.5), ("log_CH4", -5.0, 2.0)]
# Terms that literature is counted by.
LITERATURE_TERMS = [
    "water", "carbon dioxide", "sulfur dioxide", "photochemistry",
    "equilibrium", "cloud", "haze", "transmission", "emission",
    "retrieval", "atmosphere", "exoplanet", "jwst", "miri", "nirspec",
    "niriss", "nircam", "wasp", "trappist", "temperature", "metallicity",
    "abundance", "biosignature", "habitability", "rayleigh", "scattering",
    "nested sampling", "bayesian", "petitradtrans", "poseidon", "aurora",
    "SO2", "CO2", "H2O", "CH4", "CO", "Na", "K", "disequilibrium",
]

ENCODERS: dict[str, Callable[..., Column]] = {}


def register_encoder(name: str) -> Callable:
    def keep(f: Callable[..., Column]) -> Callable[..., Column]:
        ENCODERS[name] = f
        return f

    return keep


def fitted(values: Column, width: int = WIDTH) -> Column:
    """Padded with zeros or cut to ``width``, over its length (plus 1e-10)."""
    padded = F.slice(F.concat(values, F.array_repeat(F.lit(0.0), width)), 1, width)
    return let(padded, lambda v: let(F.struct(v.alias("v"), norm(v).alias("n")), lambda k: F.transform(k["v"], lambda x: x / (k["n"] + 1e-10))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _mean_or(values: Column, default: float) -> Column:
    return F.when(F.size(values) > 0, mean(values)).otherwise(F.lit(default))


def log_slope(x: Column, y: Column) -> Column:
    """Least-squares slope of ln y on ln x within [-5, 5]; 0 where x doesn't vary."""

    def of(k: Column) -> Column:
        over = F.zip_with(k["x"], k["y"], lambda a, b: (a - k["mx"]) * (b - k["my"]))
        under = F.transform(k["x"], lambda a: (a - k["mx"]) * (a - k["mx"]))
        return F.when(_sum(under) > 0, F.least(F.greatest(_sum(over) / _sum(under), F.lit(-5.0)), F.lit(5.0))).otherwise(F.lit(0.0))

    logs = F.struct(F.transform(x, lambda v: F.log(v + 1e-6)).alias("x"), F.transform(y, lambda v: F.log(F.greatest(v, F.lit(1e-6)))).alias("y"))
    return let(logs, lambda k: let(F.struct(k["x"].alias("x"), k["y"].alias("y"), mean(k["x"]).alias("mx"), mean(k["y"]).alias("my")), of))


@register_encoder("spectrum")
def spectrum(wavelengths: Column, depths: Column, uncertainties: Column) -> Column:
    """Inverse-variance means of ten bins, a band ratio, the log-log slope and 32 cosine coefficients of the standardised depths."""

    def parts(k: Column) -> Column:
        def within(low: float, high: float) -> Column:
            return F.filter(k["p"], lambda x: (x["w"] >= low) & (x["w"] < high))

        def bin_mean(low: float, high: float) -> Column:
            weighed = F.transform(within(low, high), lambda x: F.struct((x["d"] / (x["u"] * x["u"] + 1e-20)).alias("a"), (1 / (x["u"] * x["u"] + 1e-20)).alias("b")))
            return let(weighed, lambda v: F.when(F.size(v) > 0, _sum(F.transform(v, lambda x: x["a"])) / _sum(F.transform(v, lambda x: x["b"]))).otherwise(F.lit(0.0)))

        over = _mean_or(F.transform(within(4.0, 4.2), lambda x: x["d"]), 0.0)
        under = _mean_or(F.transform(within(1.3, 1.5), lambda x: x["d"]), 1e-5)
        flat = let(F.struct(k["d"].alias("d"), mean(k["d"]).alias("m"), spread(k["d"]).alias("s")), lambda v: F.transform(v["d"], lambda d: (d - v["m"]) / (v["s"] + 1e-10)))
        return F.concat(F.array(*(bin_mean(*b) for b in FEATURE_BINS), over / (under + 1e-8), log_slope(k["w"], k["d"])), cosine_transform(flat, 32))

    points = F.transform(F.arrays_zip(wavelengths.alias("w"), depths.alias("d"), uncertainties.alias("u")), lambda x: F.struct(x["w"].alias("w"), x["d"].alias("d"), x["u"].alias("u")))
    return let(F.struct(wavelengths.alias("w"), depths.alias("d"), points.alias("p")), lambda k: fitted(parts(k)))


@register_encoder("light_curve")
def light_curve(fluxes: Column) -> Column:
    """Depth, share below 0.99, variance, scatter out of transit, lag-one correlation and 32 cosine coefficients."""

    def parts(k: Column) -> Column:
        f, n = k["f"], F.size(k["f"])
        outside = F.filter(f, lambda x: x > 0.98)
        lag = F.when(n > 2, correlation(F.slice(f, 1, n - 1), F.slice(f, 2, n - 1))).otherwise(F.lit(0.0))
        below = F.size(F.filter(f, lambda x: x < 0.99)) / n
        head = F.array(F.lit(1.0) - F.array_min(f), below, k["s"] * k["s"], F.when(F.size(outside) > 2, spread(outside)).otherwise(F.lit(0.0)), lag)
        return F.concat(head, cosine_transform(F.transform(f, lambda x: x - k["m"]), 32))

    scaled = let(F.struct(fluxes.alias("f"), F.array_max(fluxes).alias("top")), lambda k: F.transform(k["f"], lambda f: f / (k["top"] + 1e-10)))
    return let(let(scaled, lambda f: F.struct(f.alias("f"), mean(f).alias("m"), spread(f).alias("s"))), lambda k: fitted(parts(k)))


@register_encoder("model")
def model(params: Column, chi2: Column, label: Column) -> Column:
    """Standardised parameters (absent ones 0), ln(1 + chi2), a flag of the family, and cosine coefficients of a fingerprint."""
    def value(name: str, default: float) -> Column:
        return F.coalesce(F.try_element_at(params, F.lit(name)), F.lit(default))

    head = [(value(name, m) - m) / s for name, m, s in MODEL_PARAMETERS]
    head += [F.log1p(F.greatest(chi2, F.lit(0.0))), F.coalesce(label.startswith("photo"), F.lit(False)).cast("double")]
    known = F.array(value("T_eq", 1000.0), F.pow(F.lit(10.0), value("log_CO2", -3.5)), F.pow(F.lit(10.0), value("log_SO2", -10.0)))
    steps = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: k / 31)
    print_ = let(known, lambda k: F.transform(steps, lambda x: F.sin(x * math.pi * k[0] / 500) * k[1] * 10 + F.cos(x * math.pi) * k[2] * 50))
    return fitted(F.concat(F.array(*head), cosine_transform(print_, 32)))


@register_encoder("literature")
def literature(text: Column) -> Column:
    """Counts of each term as a substring, and two flags."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = [substring_count(low, t.lower()).cast("double") for t in LITERATURE_TERMS]
    flags = [low.contains("so2") | low.contains("sulfur dioxide"), low.contains("photochem")]
    return fitted(F.array(*counts, *(f.cast("double") for f in flags)))


def waveform(samples: Column, length: int = 256, width: int = 128, seed: int = 42) -> Column:
    """tanh of a fixed random projection of the first ``length`` samples (zeros behind shorter ones), scaled to length one."""

    @F.pandas_udf("array<double>")
    def encode(segments: pd.Series) -> pd.Series:
        draws = np.random.RandomState(seed)
        projection = (draws.randn(width, length) / np.sqrt(length)).astype(np.float32)
        shift = (draws.randn(width) * 0.01).astype(np.float32)
        cut = np.zeros((len(segments), length), np.float32)
        for row, s in zip(cut, segments, strict=True):
            head = np.asarray(s if s is not None else [], np.float32)[:length]
            row[: len(head)] = head
        hidden = np.tanh(cut @ projection.T + shift)
        return pd.Series(list((hidden / (np.linalg.norm(hidden, axis=1, keepdims=True) + 1e-9)).astype(float)))

    return encode(samples)


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the table function ``cut_windows(values, width)`` known to SQL: place and part of each run of values."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="place int, part array<double>")
    class CutWindows:
        def eval(self, values: list, width: int) -> Iterator[tuple]:
            for at in range(0, len(values or []), width):
                yield at, list(values[at : at + width])

    spark.udtf.register("cut_windows", CutWindows)
    return ["cut_windows"]
