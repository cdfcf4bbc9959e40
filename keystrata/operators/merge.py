"""Newest-wins reads and compaction over (key, seq, ...) logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], seq: Column | str) -> DataFrame:
    """The newest row of each key.  One shuffle on the keys; map-side combined, so a hot key costs
    one row a task.  ``seq`` must be unique within a key; null sequences lose to all others."""
    rest = [c for c in log.columns if c not in keys]
    s = F.col(seq) if isinstance(seq, str) else seq
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), s).alias("_r")).select(*keys, "_r.*")


def asked(log: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """The versions of keys that are asked for; the optimiser broadcasts the keys by their size."""
    return log.join(probes.select(key).distinct(), key, "left_semi")


def multi_get(probes: DataFrame, log: DataFrame, key: str, seq: str) -> DataFrame:
    """Every probe with ``found`` and the columns of its newest version in ``log``.

    Versions of other keys go before the aggregate, so its shuffle follows the probes.
    """
    newest = latest(asked(log, probes, key), [key], seq)
    return probes.join(newest.withColumn("_hit", F.lit(True)), key, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def hits(probes: DataFrame, newest: DataFrame, key: str) -> DataFrame:
    return probes.join(newest, key, "left_semi")


def misses(probes: DataFrame, newest: DataFrame, key: str) -> DataFrame:
    return probes.join(newest, key, "left_anti")


def feed_prefix(segments: DataFrame, node: list[str], pos: str, volume: str, cap: int) -> DataFrame:
    """Per node: how many of the oldest segments reach ``cap`` bytes together, else 0."""
    from pyspark.sql import Window

    run = F.sum(volume).over(Window.partitionBy(*node).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    at = F.row_number().over(Window.partitionBy(*node).orderBy(pos))
    return segments.select(*node, run.alias("_run"), at.alias("_at")).groupBy(*node).agg(F.coalesce(F.min(F.when(F.col("_run") >= cap, F.col("_at"))), F.lit(0)).cast("bigint").alias("nr_feed"))


def compact(log: DataFrame, keys: list[str], seq: str, slot: Column) -> DataFrame:
    """Merged rows with their child slot: what a compaction writes, one output per slot."""
    return latest(log, keys, seq).withColumn("slot", slot)
