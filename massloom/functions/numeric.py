"""Small numeric expressions shared by every operator."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
# Successor of x in round-to-nearest: fl(x + fl(phi * |x|)) with phi = u * (1 + 2u).
_PHI = 2.0**-53 * (1 + 2.0**-52)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once; a repeated sub-expression inside array functions is not shared otherwise."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def r6(c: Column | str) -> Column:
    return F.round(col(c), 6)


def finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def next_up(c: Column | str) -> Column:
    """The next double above a finite, normal value."""
    c = col(c)
    return c + F.lit(_PHI) * F.abs(c)


def clip(c: Column | str, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def tolerance(mass: Column | str, ppm: float, da: float) -> Column:
    """max(da, mass * ppm * 1e-6)."""
    return F.greatest(F.lit(float(da)), col(mass) * F.lit(float(ppm)) * F.lit(1e-6))


def reciprocal(rank: Column | str) -> Column:
    """1/rank, 0 for a missing or zero rank."""
    r = col(rank)
    return F.when(r > 0, 1 / r.cast("double")).otherwise(F.lit(0.0))


def sigmoid(c: Column | str, bound: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-clip(c, -bound, bound)))


def logit(p: Column | str, floor: float = 1e-7) -> Column:
    q = clip(p, floor, 1 - floor)
    return F.log(q) - F.log1p(-q)


def zscore(value: Column | str, mean: Column, std: Column) -> Column:
    """(x - mean) / max(population std, 1e-8)."""
    return (col(value) - mean) / F.greatest(std, F.lit(1e-8))


def gaussian_penalty(mass: Column | str, observed: Column | str, ppm: float = 5.0, floor: float = 0.001) -> Column:
    m, o = col(mass), col(observed)
    sigma = F.greatest(F.lit(floor), F.abs(o) * F.lit(ppm * 1e-6))
    return -0.5 * ((m - o) / sigma) * ((m - o) / sigma)


def student_mass_prior(mass: Column | str, observed: Column | str, offset_ppm: float = 0.0,
                       scale_ppm: float = 5.0, floor: float = 0.001) -> Column:
    """Student-t(3) log prior around the offset-corrected observation."""
    corrected = col(observed) / (1 + F.lit(offset_ppm) * 1e-6)
    r = (col(mass) - corrected) / F.greatest(F.lit(floor), F.abs(corrected) * F.lit(scale_ppm) * 1e-6)
    return -2 * F.log1p(r * r / 3)


def unweight(p: Column | str, weight: Column | str) -> Column:
    """Undo positive-class weighting: p / (w (1 - p) + p)."""
    q = clip(p, 1e-7, 1 - 1e-7)
    return q / (col(weight) * (1 - q) + q)


def entropy_term(p: Column, q: Column) -> Column:
    """Jensen-Shannon style similarity of one aligned pair of peaks."""
    t = p + q
    return (t * F.log(t) - p * F.log(p) - q * F.log(q)) / (2 * F.log(F.lit(2.0)))


def bounded_evidence(e: Column | str) -> Column:
    """Evidence in [0, 1]; null means none and contributes 0; anything else fails."""
    e = col(e)
    bad = e.isNotNull() & (F.isnan(e) | (e < 0) | (e > 1))
    return F.when(bad, F.raise_error(F.lit("evidence must lie in [0, 1] or be missing")).cast("double")) \
        .otherwise(F.coalesce(e, F.lit(0.0)))
