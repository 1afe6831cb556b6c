"""Queries over the input tables; importing this package registers all of them."""

from gleaner.plans import analytics, corpus, corrupt, history, signals, streaming
from gleaner.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics", "corpus", "corrupt", "history", "signals", "streaming"]
