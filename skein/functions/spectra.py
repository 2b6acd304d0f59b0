"""Spectra: an analytic forward model, reduced chi-square and feature vectors, on arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.vectors import let, unit

# Centre, width and strength (micrometres, relative) of absorption bands, by the parameter that scales them.
BANDS = {
    "log_H2O": [(1.38, 0.10, 1.0), (1.87, 0.12, 1.2), (2.70, 0.18, 1.5)],
    "log_CO2": [(2.01, 0.05, 0.6), (4.30, 0.08, 2.0)],
    "log_SO2": [(4.05, 0.04, 0.8), (7.70, 0.15, 1.5)],
}
BASE_DEPTH = 0.013
PARAMETERS = ["T_eq", "log_H2O", "log_CO2", "log_SO2"]


def parameter(params: Column, name: str, default: float) -> Column:
    return F.coalesce(F.try_element_at(params, F.lit(name)), F.lit(default))


def parameter_vector(params: Column) -> Column:
    return F.array(*(parameter(params, p, 0.0) for p in PARAMETERS))


def forward_model(wavelengths: Column, params: Column) -> Column:
    """Depth at each wavelength: a base, a scattering slope and Gaussian bands, each clipped."""
    height = F.lit(8314.0) * parameter(params, "T_eq", 1000.0) / (F.lit(2.3) * F.pow(F.lit(10.0), parameter(params, "log_g", 3.0)))

    def clipped(x: Column, most: float) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(most))

    names = list(BANDS)

    def depth(w: Column, k: Column) -> Column:
        height = k[0]
        slope = F.lit(2 / 8.5e8 * 0.001) * height * F.exp(F.lit(-4.0) * F.log(F.greatest(w / 0.6, F.lit(1e-6))))
        out = F.lit(BASE_DEPTH) + clipped(slope, 0.002)
        for place, name in enumerate(names, 1):
            for centre, width, strength in BANDS[name]:
                out = out + clipped(k[place] * strength * F.exp(F.lit(-0.5) * F.pow((w - centre) / width, F.lit(2))), 0.005)
        return out

    amounts = [F.pow(F.lit(10.0), parameter(params, name, -10.0)) * 1e4 for name in names]
    return let(F.array(height, *amounts), lambda k: F.transform(wavelengths, lambda w: depth(w, k)))


def reduced_chi2(depths: Column, model: Column, uncertainties: Column) -> Column:
    residuals = F.zip_with(F.zip_with(depths, model, lambda d, f: d - f), uncertainties, lambda r, u: F.pow(r / (u + 1e-20), F.lit(2)))
    n = F.size(depths)
    return F.when(n > 0, F.aggregate(residuals, F.lit(0.0), lambda s, x: s + x) / n).otherwise(F.lit(1.0))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def spread(values: Column) -> Column:
    """Population standard deviation."""
    return let(F.struct(values.alias("v"), mean(values).alias("m")), lambda k: F.sqrt(F.aggregate(k["v"], F.lit(0.0), lambda s, x: s + (x - k["m"]) * (x - k["m"])) / F.size(k["v"])))


def cosine_transform(values: Column, count: int) -> Column:
    """First ``count`` orthonormal DCT-II coefficients, zeros beyond the length."""
    def coefficient(values: Column, k: int) -> Column:
        n = F.size(values).cast("double")
        terms = F.transform(values, lambda x, i: x * F.cos(F.lit(math.pi * k) * (F.lit(2.0) * i + 1) / (n * 2)))
        scale = F.sqrt(F.lit(1.0 if k == 0 else 2.0) / n)
        return F.when(n > k, F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) * scale).otherwise(F.lit(0.0))

    return let(values, lambda v: F.array(*(coefficient(v, k) for k in range(count))))


def band_mean(wavelengths: Column, depths: Column, low: float, high: float, default: float = 0.0) -> Column:
    inside = F.filter(F.zip_with(wavelengths, depths, lambda w, d: F.when((w >= low) & (w < high), d)), lambda x: x.isNotNull())
    return F.when(F.size(inside) > 0, mean(inside)).otherwise(F.lit(default))


def detector_embedding(wavelengths: Column, depths: Column, width: int = 16) -> Column:
    """DCT of the standardised depths, three band means and the spread, cut to ``width`` and scaled to length one."""
    known = F.struct(wavelengths.alias("w"), depths.alias("d"), mean(depths).alias("m"), spread(depths).alias("s"))

    def parts(k: Column) -> Column:
        standard = F.transform(k["d"], lambda d: (d - k["m"]) / (k["s"] + 1e-10))
        means = F.array(*(band_mean(k["w"], k["d"], a, b) for a, b in ((1.0, 2.0), (2.0, 5.0), (5.0, 12.0))), k["s"])
        return F.concat(cosine_transform(standard, min(width - 4, 24)), means)

    return let(let(known, lambda k: F.slice(parts(k), 1, width)), unit)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's of two arrays of one length; 0 where it isn't defined."""

    def of(k: Column) -> Column:
        terms = F.zip_with(k["x"], k["y"], lambda a, b: (a - k["mx"]) * (b - k["my"]))
        spreads = spread(k["x"]) * spread(k["y"])
        return F.when(spreads > 0, mean(terms) / spreads).otherwise(F.lit(0.0))

    return let(F.struct(x.alias("x"), y.alias("y"), mean(x).alias("mx"), mean(y).alias("my")), of)
