"""All queries of the engine."""

from __future__ import annotations

from . import crossval, curve, display, evaluation, event_study, features, forests, joins, joint, leakage, learning, ledgers, refits, relevance, rules, snapshots, streams, technicals  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "purged_har_walkforward"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
