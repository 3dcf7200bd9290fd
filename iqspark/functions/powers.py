"""Digital amplitudes, accumulated levels and physical power."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale of a mixer that is not set to 1.0: a fixed value.
MIXER_SCALE = 0.7071067811865475


def _c(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _double(x: Any) -> Column:
    return _c(x).cast("double")


@dataclass(frozen=True)
class TxChain:
    """Settings and stage values of the sending chain; each is a number or a column."""

    psb_fftshift: Any
    psb_scale: Any = 1.0
    mixer_scale_is_1p0: Any = True
    mixer_qmc_gain: Any = 1.0
    vop_current: Any = 20000.0
    vop_current_fs: Any = 20000.0
    dac_dbfs_to_dbm: Any = -6.0
    combiner_loss_db: Any = 0.0
    attenuator_db: Any = 0.0
    if_s21_db: Any = 0.0
    mixer_loss_db: Any = 0.0
    rf_s21_db: Any = 0.0
    cryostat_s21_db: Any = 0.0
    dac_fs_bits: int = 16

    def shift(self) -> Column:
        return F.pow(F.lit(2.0), F.bit_count(_c(self.psb_fftshift)) + 1)

    def mixer(self) -> Column:
        return F.when(_c(self.mixer_scale_is_1p0), F.lit(MIXER_SCALE)).otherwise(F.lit(1.0))

    def vop(self) -> Column:
        ratio = _double(self.vop_current) / _double(self.vop_current_fs)
        return ratio * ratio


def tone_power_stages(amplitude: Column, c: TxChain) -> dict[str, Column]:
    """Every stage from amplitude to power at the detector in dBm, in order; losses count by size, gains by sign."""
    shifted = amplitude / c.shift()
    scaled = shifted * _double(c.psb_scale)
    duc = scaled * _double(c.mixer_qmc_gain) / c.mixer()
    vop = duc * duc * c.vop()
    dbfs = 10 * F.log10(F.abs(vop))
    dac = dbfs + _double(c.dac_dbfs_to_dbm)
    combined = dac - F.abs(_double(c.combiner_loss_db))
    tx_if = combined + _double(c.if_s21_db) - F.abs(_double(c.attenuator_db))
    mixed = tx_if - F.abs(_double(c.mixer_loss_db))
    rf = mixed + _double(c.rf_s21_db)
    return {"amps": amplitude, "psb_shift_units": shifted, "psb_scale_units": scaled, "dac_units": scaled * float(2**c.dac_fs_bits), "dac_fs": scaled, "duc_fs": duc, "duc_fs_power": duc * duc, "vop_fs": vop, "vop_dbfs": dbfs, "dac_dbm": dac, "combiner_dbm": combined, "tx_if_dbm": tx_if, "tx_mixer_dbm": mixed, "tx_rf_dbm": rf, "cryostat_dbm": rf + _double(c.cryostat_s21_db)}


def tone_power(amplitude: Column, c: TxChain) -> Column:
    return tone_power_stages(amplitude, c)["cryostat_dbm"]


def tone_power_details(amplitude: Column, c: TxChain) -> Column:
    return F.struct(*[v.alias(k) for k, v in tone_power_stages(amplitude, c).items()])


def tone_amplitude(power_dbm: Column, c: TxChain) -> Column:
    """The (positive) amplitude that gives a power: the inverse of tone_power."""
    dac = power_dbm - _double(c.cryostat_s21_db) - _double(c.rf_s21_db) + F.abs(_double(c.mixer_loss_db)) - _double(c.if_s21_db) + F.abs(_double(c.attenuator_db)) + F.abs(_double(c.combiner_loss_db))
    duc = F.sqrt(F.pow(F.lit(10.0), (dac - _double(c.dac_dbfs_to_dbm)) / 10) / c.vop())
    return duc * c.mixer() / _double(c.mixer_qmc_gain) / _double(c.psb_scale) * c.shift()


@dataclass(frozen=True)
class RxChain:
    """Settings of the receiving chain; each is a number or a column."""

    adc_dbm_to_dbfs: Any
    mixer_qmc_gain: Any = 1.0
    mixer_scale_is_1p0: Any = True
    adc_bits: int = 16
    pfb_fftshift: Any = 0
    rx_mix_scale: Any = 1.0
    acc_len: Any = 1
    window_factor: Any = 1.0

    def gain(self) -> Column:
        """Accumulated level for each unit of amplitude at the converter."""
        fft = F.pow(F.lit(2.0), F.lit(13) - F.bit_count(_c(self.pfb_fftshift)))
        return fft * _double(self.rx_mix_scale) * _double(self.acc_len) * _double(self.window_factor) * float(2 ** (self.adc_bits - 1))

    def mixer(self) -> Column:
        return F.when(_c(self.mixer_scale_is_1p0), F.lit(1.0)).otherwise(F.lit(1 / math.sqrt(2)))


def accumulated_level(power_dbm: Column, c: RxChain, phase: Column | float = math.pi / 4) -> tuple[Column, Column]:
    """(i, q) that a power at the converter accumulates to."""
    rms = F.pow(F.lit(10.0), (power_dbm - _double(c.adc_dbm_to_dbfs)) / 20)
    level = rms * math.sqrt(2) * _double(c.mixer_qmc_gain) * c.mixer() * c.gain()
    return level * F.cos(_c(phase)), level * F.sin(_c(phase))


def adc_input_power(i: Column, q: Column, c: RxChain) -> Column:
    """Power at the converter of an accumulated value, by its magnitude, so that it is defined on both axes; null at 0."""
    rms = F.hypot(i, q) / c.gain() / c.mixer() / _double(c.mixer_qmc_gain) / math.sqrt(2)
    return 20 * F.log10(rms) + _double(c.adc_dbm_to_dbfs)
