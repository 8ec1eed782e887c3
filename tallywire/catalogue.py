"""Queries of the core library by name, and the DuckDB SQL each agrees with."""

from __future__ import annotations

from tallywire.plans import codecs, control, files, frames, monitoring, packets, streams, triggers, waveforms
from tallywire.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "codecs", "control", "files", "frames", "monitoring", "packets", "streams", "triggers", "waveforms"]
