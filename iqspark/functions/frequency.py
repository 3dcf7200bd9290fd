"""Frequencies between RF, converter and filterbank, sample rates and sweep grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Board


def _zone(zone: Column | int, f: Column, clk_hz: float) -> Column:
    z = F.lit(zone) if isinstance(zone, int) else zone
    bad = F.raise_error(F.concat(F.lit("Nyquist zone must be 1 or 2, not "), z.cast("string"))).cast("double")
    return F.when(z == 1, f).when(z == 2, 2 * clk_hz - f).otherwise(bad)


def rf_to_analog(rf: Column, lo_hz=0.0, sideband=1, connected: bool = True) -> Column:
    return (rf - lo_hz) / sideband if connected else rf


def rf_to_baseband(rf: Column, mixer_hz, zone: Column | int = 1, lo_hz=0.0, sideband=1, connected: bool = True, receive: bool = False, board: Board = Board()) -> Column:
    """Digital baseband frequency; mixer_hz is the converter's mixer (subtracted when sending, added when receiving)."""
    digital = _zone(zone, rf_to_analog(rf, lo_hz, sideband, connected), board.clk_hz)
    return digital + mixer_hz if receive else digital - mixer_hz


def baseband_to_analog(bb: Column, mixer_hz, zone: Column | int = 1, receive: bool = False, board: Board = Board()) -> Column:
    return _zone(zone, bb - mixer_hz if receive else bb + mixer_hz, board.clk_hz)


def baseband_to_rf(bb: Column, mixer_hz, zone: Column | int = 1, lo_hz=0.0, sideband=1, connected: bool = True, receive: bool = False, board: Board = Board()) -> Column:
    analog = baseband_to_analog(bb, mixer_hz, zone, receive, board)
    return lo_hz + sideband * analog if connected else analog


def mixer_frequency(zone: Column | int, board: Board = Board()) -> tuple[Column, Column]:
    """(up-converter, down-converter) mixer frequency that centres a Nyquist zone."""
    z = F.lit(zone) if isinstance(zone, int) else zone
    bad = F.raise_error(F.concat(F.lit("Nyquist zone must be 1 or 2, not "), z.cast("string"))).cast("double")
    up = F.when(z == 1, F.lit(2 * board.clk_hz / 4)).when(z == 2, F.lit(-2 * board.clk_hz * 3 / 4)).otherwise(bad)
    return up, -up


def nearest_bin(bb: Column, n_bins: int, board: Board = Board()) -> Column:
    """Nearest filterbank bin, 0 to n - 1 (ties to even), in closed form instead of a search over the grid."""
    clipped = F.greatest(F.least(bb / board.clk_hz * n_bins, F.lit(n_bins / 2 - 1)), F.lit(-n_bins / 2))
    return F.pmod(F.bround(clipped), F.lit(n_bins)).cast("int")


def bin_centre(b: Column, n_bins: int, board: Board = Board()) -> Column:
    return F.when(b < n_bins / 2, b).otherwise(b - n_bins) * (board.clk_hz / n_bins)


def bin_offset(bb: Column, n_bins: int, board: Board = Board()) -> Column:
    return bb - bin_centre(nearest_bin(bb, n_bins, board), n_bins, board)


def out_of_band(bb: Column, n_bins: int, rbw_hz: float, board: Board = Board()) -> Column:
    low, high = -board.clk_hz / 2, (n_bins / 2 - 1) * board.clk_hz / n_bins + rbw_hz
    return (bb < low) | (bb > high)


def require_in_band(bb: Column, n_bins: int, rbw_hz: float, board: Board = Board()) -> Column:
    """bb itself; the job fails on a tone outside the baseband."""
    return F.when(out_of_band(bb, n_bins, rbw_hz, board), F.raise_error("tone outside the baseband").cast("double")).otherwise(bb)


def phase_increment(offset_hz: Column, rbw_hz: float) -> Column:
    return offset_hz / rbw_hz * (2 * math.pi)


def sample_rate(acc_len: Column, board: Board = Board()) -> Column:
    return board.fft_bw_hz / acc_len


def accumulation_length(rate_hz: Column, board: Board = Board()) -> Column:
    """Length nearest to a requested rate (half to even), up to a multiple of 4, within 1 to 65535; null for a rate of 0."""
    exact = F.try_divide(F.lit(board.fft_bw_hz), rate_hz)
    return F.when(exact.isNotNull(), F.greatest(F.least(4 * F.ceil(F.bround(exact) / 4), F.lit(65535)), F.lit(1)).cast("long"))


def sweep_frequency(centre: Column, span: Column, point: Column, points: int, direction: str = "up") -> Column:
    """Point 0 to points - 1 of points equal steps over the span around the centre; one point: the start."""
    if direction not in ("up", "down"):
        raise ValueError("direction must be up or down")
    at = point if direction == "up" else F.lit(points - 1) - point
    if points == 1:
        return centre - span / 2
    return F.when(at == points - 1, centre + span / 2).otherwise(centre - span / 2 + at * span / (points - 1))
