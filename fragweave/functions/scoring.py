"""Distances and probabilities as column expressions."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_WEIGHT = sys.float_info.max

# Smallest coverage, smallest Poisson probability, the two distance distributions.
COVERAGE_FLOOR = 1e-4
PMF_FLOOR = 1e-10
MU_INTRA, SIGMA_INTRA = 0.0, 0.01037897 / 2
MU_INTER, SIGMA_INTER = 0.0676654, 0.03419337

# The public Lanczos coefficients for g = 7, n = 9.
_G = 7.0
_LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def floored(cov: Column, floor: float = COVERAGE_FLOOR) -> Column:
    return F.greatest(cov, F.lit(floor))


def lgamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5."""
    z = x - 1.0
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + F.lit(float(k)))
    t = z + F.lit(_G + 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def normal_pdf(x: Column, mean: float, sd: float) -> Column:
    z = (x - F.lit(mean)) / F.lit(sd)
    return F.exp(-z * z / 2.0) / F.lit(sd * math.sqrt(2 * math.pi))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def composition_probability(distance: Column) -> Column:
    """That two sequences at this distance are of one genome; null where both densities vanish."""
    same = normal_pdf(distance, MU_INTRA, SIGMA_INTRA)
    return F.try_divide(same, same + normal_pdf(distance, MU_INTER, SIGMA_INTER))


def poisson(k: Column, rate: Column) -> Column:
    """The probability of k at a rate, for real k."""
    return F.exp(k * F.ln(rate) - lgamma(k + 1.0) - rate)


def coverage_probability(a: Column, b: Column, floor: float = PMF_FLOOR) -> Column:
    """The smaller of the products of floored probabilities both ways, over the length of ``a``."""

    def one_way(x: Column, y: Column) -> Column:
        each = F.zip_with(x, y, lambda p, q: F.greatest(poisson(p, q), F.lit(floor)))
        return F.aggregate(each, F.lit(1.0), lambda s, v: s * v)

    b = F.slice(b, 1, F.size(a))
    return F.least(one_way(a, b), one_way(b, a))


def weight(p_comp: Column, p_cov: Column) -> Column:
    """-log10 of the joint probability; the largest double where that is not positive."""
    return F.when(p_comp * p_cov > 0, -(F.log10(p_comp) + F.log10(p_cov))).otherwise(F.lit(MAX_WEIGHT))


def pair_weight(profile_a: Column, cov_a: Column, profile_b: Column, cov_b: Column) -> Column:
    return weight(composition_probability(euclidean(profile_a, profile_b)), coverage_probability(cov_a, cov_b))


def mean_weight(total: Column, n: Column) -> Column:
    """Total / n, with an infinite total as the largest double."""
    return F.when(total >= F.lit(float("inf")), F.lit(MAX_WEIGHT)).otherwise(total / n)


def threshold(p: float) -> float:
    if not 0 < p <= 1:
        raise ValueError("a probability in (0, 1] is needed")
    return -math.log10(p)


def threshold_column(p: Column) -> Column:
    """The same of a column; values outside (0, 1] are an error."""
    return F.when((p > 0) & (p <= 1), -F.log10(p)).otherwise(F.raise_error(F.lit("a probability in (0, 1] is needed")).cast("double"))
