"""Constants of the store's logical layout; tests scale the capacities down."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
BARRELS = 8191
BLOCK_BYTES = 4088
FANOUT = 8
LEVELS = 5
CHAINS = 64
BLOOM_BITS_PER_KEY = 16
BLOOM_PROBES = 11
INDEX_CAP = 2048
COVER_PERCENT = 99
LATENCY_BUCKETS = 100_000


@dataclass(frozen=True)
class Config:
    """Capacities of a store; the defaults are those of full-size 32 MB segments."""

    segment_bytes: int = 25_113_606
    feed_bytes: int = 241_591_910
    most_segments: int = 20
    level_paths: tuple[str, ...] = ()
    bloom_ndv: int = 1_000_000
