"""Ranks, percentiles, windows and broadcasts that hold up under skew.

A plain ``Window.partitionBy(k)`` sorts each group inside one task, so a group
with a third of all rows decides the run time and may not fit. The helpers here
give the same results with tasks of bounded size.
"""

from gleaner.scale.blocks import against, matrix, parts_of
from gleaner.scale.broadcasts import broadcast_if_small, collect_bounded
from gleaner.scale.frames import numeric_order, over_history
from gleaner.scale.ranks import exact_percentiles, group_rank, hash_key, hash_prefix

__all__ = [
    "against",
    "broadcast_if_small",
    "collect_bounded",
    "exact_percentiles",
    "group_rank",
    "hash_key",
    "hash_prefix",
    "matrix",
    "numeric_order",
    "over_history",
    "parts_of",
]
