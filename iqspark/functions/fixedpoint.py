"""Fixed-point words of phases, amplitudes and complex values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def phase_to_fixed(phase: Column, bits: int) -> Column:
    """Half turns wrapped to [-1, 1), scaled by 2**bits, cut towards 0 (steps and offsets alike)."""
    return ((F.pmod(phase / math.pi + 1, F.lit(2.0)) - 1) * float(2**bits)).cast("long")


def fixed_to_phase(word: Column, bits: int) -> Column:
    return word.cast("double") / float(2**bits) * math.pi


def amplitude_to_fixed(amplitude: Column, bits: int) -> Column:
    """Rounded half to even; the largest word is 2**bits - 1."""
    return F.least(F.bround(amplitude * float(2**bits)).cast("long"), F.lit(2**bits - 1))


def fixed_to_amplitude(word: Column, bits: int) -> Column:
    return word.cast("double") / float(2**bits)


def complex_to_word(re: Column, im: Column, bits: int) -> Column:
    """Two's complement parts side by side, rounded half to even; only the top saturates."""
    half = 2 ** (bits - 1)
    part = lambda x: F.pmod(F.least(F.bround(x * float(half)).cast("long"), F.lit(half - 1)), F.lit(2**bits))
    return F.shiftleft(part(re), bits).bitwiseOR(part(im))


def word_to_complex(word: Column, bits: int) -> tuple[Column, Column]:
    half, mask = 2 ** (bits - 1), 2**bits - 1
    signed = lambda x: F.when(x >= half, x - 2**bits).otherwise(x) / float(half)
    return signed(F.shiftrightunsigned(word, bits).bitwiseAND(F.lit(mask))), signed(word.bitwiseAND(F.lit(mask)))
