"""Columns of complex values, kept as a pair (i, q)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def magnitude(i: Column, q: Column) -> Column:
    return F.hypot(i, q)


def exact_mean(c: Column | str) -> Column:
    """Aggregate: the mean to a last bit that does not hang on the order in which parts are added up. For phases: opposite
    means are half a turn apart, and a mean of nearly 0 points anywhere, so their last bit can turn all that follows.

    Each value is cut into a multiple of 2^-10, one of 2^-40 and a rest. The three sums are exact as long as absolute values
    sum to less than 2^43 over 2^22 values; beyond, and for parts below 2^-72, they are rounded as any sum is."""
    x = F.col(c) if isinstance(c, str) else c
    inside = F.abs(x) < 2.0**42
    high = F.when(inside, F.rint(x * 2.0**10) / 2.0**10).otherwise(x)
    rest = F.when(inside, x - high).otherwise(F.lit(0.0))
    middle = F.rint(rest * 2.0**40) / 2.0**40
    return F.try_divide(F.sum(high) + F.sum(middle) + F.sum(rest - middle), F.count(x))


def log_magnitude(i: Column, q: Column) -> Column:
    """20 log10 |z| in dB; null at 0."""
    return 20 * F.log10(F.hypot(i, q))


def angle(i: Column, q: Column) -> Column:
    return F.atan2(q, i)


def wrap_phase(p: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(p + math.pi, F.lit(TAU)) - math.pi


def rotate(i: Column, q: Column, theta: Column) -> tuple[Column, Column]:
    """z exp(-j theta)."""
    return i * F.cos(theta) + q * F.sin(theta), q * F.cos(theta) - i * F.sin(theta)


def bin_number(f: Column, lo_hz: float = 4e9, half_hz: float = 1024e6, bins: int = 4096) -> Column:
    """Filterbank bin of an RF frequency below a local oscillator, ties to even."""
    return F.bround((F.lit(lo_hz) - f - half_hz) / half_hz * bins)


def odd_bin(f: Column, **grid) -> Column:
    return F.pmod(bin_number(f, **grid), F.lit(2)) == 1


def flip_odd_bins(i: Column, q: Column, f: Column, **grid) -> tuple[Column, Column]:
    odd = odd_bin(f, **grid)
    return F.when(odd, -i).otherwise(i), F.when(odd, -q).otherwise(q)


def magnitude_error(i: Column, q: Column, ei: Column, eq: Column, model: str = "literal") -> Column:
    """Error of |z|. literal uses ei for both parts, as recorded spectra have it; propagated uses eq for q."""
    second = {"literal": ei, "propagated": eq}[model]
    return F.try_divide(F.hypot(i * ei, q * second), F.hypot(i, q))


def log_magnitude_error(i: Column, q: Column, ei: Column, eq: Column, model: str = "literal") -> Column:
    return F.try_divide(F.lit(20 / math.log(10)) * magnitude_error(i, q, ei, eq, model), F.hypot(i, q))


def phase_error(i: Column, q: Column, ei: Column, eq: Column) -> Column:
    return F.try_divide(F.hypot(q * ei, i * eq), i * i + q * q)
