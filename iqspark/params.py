"""Board and chain settings that the jobs take as parameters, and typed access to nested configuration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Board:
    """Sizes of a readout board; the defaults are inferred ones, so they stay parameters."""

    clk_hz: float = 2048e6
    n_tx_bins: int = 4096
    n_rx_bins: int = 8192
    rx_oversample: int = 2
    phase_bits: int = 31
    step_bits: int = 16

    @property
    def fft_bw_hz(self) -> float:
        """Rate at which the receive filterbank gives frames before accumulation."""
        return self.clk_hz / (self.n_rx_bins / self.rx_oversample)


def number(value: Any) -> Any:
    """A configuration value as a number where it is one: YAML readers give 0.5e9 as text. Lists are read through."""
    if isinstance(value, str):
        try:
            return float(value)
        except ValueError:
            return value
    if isinstance(value, (list, tuple)):
        return [number(v) for v in value]
    return value


#: Names under which one setting is found: fixed values.
ALIASES = {"adc_ddc_mixer_frequency_hz": ["adc_ddc_mix_frequency_hz"], "tone_frequencies": ["frequencies"], "tone_amplitudes": ["amplitudes"], "tone_phases": ["phases"]}


def setting(config: Mapping[str, Any], *path: str, default: Any = None) -> Any:
    """The number, text or list at path of a nested configuration; default if any part is absent or null."""
    for key in path:
        names = [key, *ALIASES.get(key, []), *[k for k, v in ALIASES.items() if key in v]]
        found = next((config[n] for n in names if isinstance(config, Mapping) and config.get(n) is not None), None)
        if found is None:
            return default
        config = found
    return config if isinstance(config, Mapping) else number(config)
