"""Clocks. Every stage asks its clock for ``now``; nothing reads the wall clock directly.

``WallClock`` is what a live streaming job uses: ``unix_millis(current_timestamp())``,
constant within a micro-batch. ``SyntheticClock`` is deterministic: each hop adds a
bounded, hashed delay to the incoming ``timestamp``, so time never goes backwards
and results can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopline.functions.draws import hash32


class WallClock:
    knows_append_time = False

    def entry(self, row_id: Column, message_ts: Column) -> Column:
        return F.unix_millis(F.current_timestamp())

    def hop(self, timestamp: Column, row_id: Column, component: str) -> Column:
        return F.unix_millis(F.current_timestamp())

    def window(self, max_timestamp: Column, lane: Column, win: Column, component: str) -> Column:
        return F.unix_millis(F.current_timestamp())

    def append(self, now: Column, row_id: Column) -> Column:
        # the broker stamps log-append time; before the broker it is unknown
        return F.lit(None).cast("bigint")


class SyntheticClock:
    """Deterministic clock; the delay bounds are parameters."""

    knows_append_time = True

    def __init__(self, entry_ms: int = 20, hop_ms: int = 50, append_ms: int = 30):
        self.entry_ms, self.hop_ms, self.append_ms = entry_ms, hop_ms, append_ms

    def entry(self, row_id: Column, message_ts: Column) -> Column:
        return message_ts + hash32(row_id, "entry") % self.entry_ms

    def hop(self, timestamp: Column, row_id: Column, component: str) -> Column:
        return timestamp + hash32(row_id, component, "clock") % self.hop_ms

    def window(self, max_timestamp: Column, lane: Column, win: Column, component: str) -> Column:
        return max_timestamp + hash32(lane, win, component, "clock") % self.hop_ms

    def append(self, now: Column, row_id: Column) -> Column:
        return now + hash32(row_id, "append") % self.append_ms
