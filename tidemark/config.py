"""Settings of a run as JSON: what a file says over the defaults."""

from __future__ import annotations

import json
from pathlib import Path

from .operators.backtest import FEE, SLIPPAGE

DEFAULTS = {"fee": FEE, "slippage": SLIPPAGE, "capital": 100_000.0, "periods": 252, "objective": "sharpe_ratio"}


def save(path: str, settings: dict) -> None:
    """Write settings; ValueError for names that are none."""
    if unknown := set(settings) - set(DEFAULTS):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    Path(path).write_text(json.dumps(settings, indent=2))


def load(path: str) -> dict:
    """The settings of a file, defaults for the rest; the defaults alone without a file."""
    p = Path(path)
    return {**DEFAULTS, **(json.loads(p.read_text()) if p.exists() else {})}
