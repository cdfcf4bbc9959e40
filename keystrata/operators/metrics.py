"""Counters, ratios, histograms and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.config import LATENCY_BUCKETS
from keystrata.session import checkpoint_dir


def ratio(a: Column, b: Column, factor: float = 1.0) -> Column:
    """factor * a / b, null where b is 0, rounded to nine digits."""
    return F.round(F.try_divide(a.cast("double") * factor, b.cast("double")), 9)


def latency_histogram(usec: DataFrame) -> DataFrame:
    """(bucket, count) of one-microsecond buckets; slower operations are dropped."""
    return usec.where((F.col("usec") >= 0) & (F.col("usec") < LATENCY_BUCKETS)).groupBy(F.col("usec").alias("bucket")).agg(F.count("*").alias("count"))


def latency_percentiles(usec: DataFrame, per_mille: list[int]) -> DataFrame:
    """First bucket whose cumulative count reaches floor(p * N); at most 100,000 buckets are windowed."""
    h = latency_histogram(usec)
    run = F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("count").over(Window.partitionBy())
    cum = h.select("bucket", run.alias("cum"), total.alias("n"))
    return cum.agg(*[F.min(F.when(F.col("cum") >= F.expr(f"n * {p} div 1000"), F.col("bucket"))).alias(f"p{p}") for p in per_mille], F.max("bucket").alias("max_bucket"))


def throughput(ops: DataFrame, op: str, ts: str, every: int) -> DataFrame:
    """Per batch of ``every`` operations: ops, last time, microseconds since the last batch, rate."""
    batches = ops.groupBy(F.floor(F.col(op) / every).cast("bigint").alias("batch")).agg(F.count("*").alias("ops"), F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("until"))
    ranged = _ranged(batches, "batch")
    ends = ranged.groupBy("_part").agg(F.max_by("until", F.struct("batch")).alias("_u"))
    before = ends.select("_part", F.lag("_u").over(Window.orderBy("_part")).alias("_before"))  # one row a partition
    inside = Window.partitionBy("_part").orderBy("batch")
    last = F.when(F.row_number().over(inside) == 1, F.col("_before")).otherwise(F.lag("until").over(inside))
    rows = ranged.join(F.broadcast(before), "_part").withColumn("delta_usec", F.col("until") - last).drop("_part", "_before")
    return rows.withColumn("qps", F.round(F.try_divide(F.col("ops") * 1e6, F.col("delta_usec").cast("double")), 6))


def distribution(values: DataFrame, value: str) -> DataFrame:
    """Sorted value at index count * i / 100 for i = 5, 10, ..., 95, with count, least and largest."""
    h = values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    run = prefix_sums(h, "v", "c")
    held = F.expr("filter(sequence(5L, 95L, 5L), p -> upto > n * p div 100 and upto - c <= n * p div 100)")
    points = run.select(F.col("v").alias("value"), F.explode(held).alias("pct"))
    edges = h.agg(F.sum("c").alias("count"), F.min("v").alias("least"), F.max("v").alias("largest"))
    return points.select("pct", "value").crossJoin(F.broadcast(edges))  # one row


def _ranged(rows: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """``rows`` range-sorted by ``order``, checkpointed, with the number of their partition in ``_part``."""
    spark = rows.sparkSession
    checkpoint_dir(spark)
    count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(count, order).withColumn("_part", F.spark_partition_id()).checkpoint()


def prefix_sums(rows: DataFrame, order: str, amount: str, parts: int | None = None) -> DataFrame:
    """``rows`` (with distinct ``order``) with ``upto``, the sum of ``amount`` up to a row, and ``n``, the sum of all.

    Rows are range-sorted; only one sum per partition is windowed, so no task holds them all.
    """
    ranged = _ranged(rows, order, parts)
    sums = ranged.groupBy("_part").agg(F.sum(amount).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_part", before.alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("n"))  # one row a partition
    inside = F.sum(amount).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_in", inside).join(F.broadcast(offsets), "_part").withColumn("upto", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def io_report(ops: DataFrame, nbytes: str, ts: str) -> DataFrame:
    """Operations, seconds from first to last, operations a second, MiB and MiB a second."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    one = ops.agg(F.count("*").alias("ops"), ((F.max(at) - F.min(at)) / 1e6).alias("seconds"), F.sum(nbytes).alias("b"))
    mib = F.col("b") / float(1 << 20)
    return one.select("ops", "seconds", ratio(F.col("ops"), F.col("seconds")).alias("iops"), F.round(mib, 9).alias("mib"), ratio(mib, F.col("seconds")).alias("mib_per_sec"))


def heavy_hitters(values: DataFrame, value: str) -> DataFrame:
    """Values that make up at least one percent of the rows."""
    total = values.agg(F.count("*").alias("n"))
    return values.groupBy(value).agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).where("c >= n div 100").select(value, "c")  # one row


def unit_map(units: DataFrame, per_line: int = 64) -> DataFrame:
    """(line, map, used): '*' for a used unit, '-' for a free one, '#' beyond the end."""
    at = F.struct(F.pmod("unit_id", F.lit(per_line)).alias("i"), F.when(F.col("used"), "*").otherwise("-").alias("c"))
    lines = units.groupBy((F.floor(F.col("unit_id") / per_line)).cast("bigint").alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda x: x.c), "").alias("m"), F.sum(F.col("used").cast("bigint")).alias("used"))
    return lines.select("line", F.rpad("m", per_line, "#").alias("map"), "used")
