"""Data contracts and configuration records (driver-side, small)."""

from __future__ import annotations

from dataclasses import dataclass

# Default split: partition membership comes from the capture weekday only.
DEFAULT_ASSIGNMENT = {
    "train": ("Monday", "Tuesday", "Wednesday"),
    "validation": ("Thursday",),
    "test": ("Friday",),
}


@dataclass(frozen=True)
class MonitoringConfig:
    window_size: int = 500
    minimum_window_size: int = 50
    drift_share_threshold: float = 0.30
    psi_threshold: float = 0.20
    minimum_labelled_rows: int = 20
    min_attack_support: int = 1
    min_benign_support: int = 1
