"""Compaction: several runs into one, with nothing that is still needed lost.

A tombstone may go only if no version that it hides can be left: when no live segment
outside the selection has older rows in the selection's key range.  Expired rows are
tombstones here.  The log's tail is always newer, so it never needs them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from kvlake.sources.manifest import Segment

from .merge import as_tombstones, latest


def may_drop_tombstones(chosen: Sequence[Segment], others: Sequence[Segment]) -> bool:
    if not chosen:
        return True
    low, high = min(s.min_key for s in chosen), max(s.max_key for s in chosen)
    newest = max(s.max_seq for s in chosen)
    return not any(s.min_seq < newest and s.min_key <= high and s.max_key >= low for s in others)


def compacted(rows: DataFrame, now_ms: int, drop_tombstones: bool) -> DataFrame:
    """The newest version of each key of the selection."""
    out = as_tombstones(latest(rows), now_ms)
    return out.where(~out["tombstone"]) if drop_tombstones else out
