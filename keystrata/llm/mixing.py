"""Mixing sources to target weights by hash-random order, range sort and distributed prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.session import checkpoint_dir

GAP = r"[\x20\x09-\x0D]+"
PART_ROWS = 500_000
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # the mix takes 3/2 of all words
EPOCHS = 2
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn.  The words to share out are
    ``share`` of all; no target exceeds ``epochs`` times its source, and what is above goes to the
    others by weight.  That fixed point is min(epochs * size, level * weight): in the order of
    size / weight the first sources are full, and the level is what is left per weight.
    """
    up, down = share
    numbered = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))  # one row a source
    weighed = numbered.select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).alias("w"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    steps = weighed.select(
        "source", "source_size", "w",
        F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        F.sum("source_size").over(whole).alias("total"),
    )
    left = F.col("total") * up - F.col("before") * (epochs * down)
    fits = left * F.col("w") <= F.col("source_size") * F.col("rest") * (epochs * down)
    level = steps.withColumn("left", left).withColumn("fits", fits)
    first = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("w"), "left", "rest"))).over(whole)
    done = level.withColumn("at", first)
    share_of = F.col("at.left") * F.col("w") / (F.col("at.rest") * F.lit(down))
    most = F.col("source_size") * F.lit(float(epochs))  # no level is found where the share asks for more than all sources give
    return done.select("source", "source_size", F.least(most, F.coalesce(share_of, most)).alias("target"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, source, words) of a sorted partition; a partition holds few sources or one."""
    held: dict = {}
    part = None
    for batch in batches:
        for p, s, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            part = p
            held[s] = held.get(s, 0) + n
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int64()), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["part", "source", "words"])


def _prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the words before each row within its partition and source; the last column is size."""
    source, run = (), 0
    for batch in batches:
        before = []
        for s, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if s != source:
                source, run = s, 0
            before.append(run)
            run += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], [*batch.schema.names, "before"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per input row: doc_id, tag, source, size, source_size, target, taken.

    Each row gets a hash-random key; rows are range-sorted by source and key, and prefix sums of
    words cut the order at the source's budget, round(target).  A budget above the source's size
    starts a second epoch in the same order.  The row at the cut gives only the words that fit, so
    a source's ``taken`` sums up to its budget exactly.  ``tag`` is xxhash64 of the text.

    Only ids, sizes and keys are moved.  A source may be spread over any number of partitions; the
    driver sees nothing, and what is joined back is one row per partition and source.

    Null or empty texts have size 0 and take nothing; the null source is a source of its own, the
    last in order; rows that repeat an id are taken each by itself.  An empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), GAP), lambda x: x != "")).cast("long")
    rows = docs.select(F.col(source_col).alias("source"), words.alias("size"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"))
    rows = rows.withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))))
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size"), F.col("tag")]
    path = f"{checkpoint_dir(spark)}/mix-sizes-{uuid.uuid4().hex}"
    rows.write.parquet(path)  # drawing ranges would count the words twice
    rows = spark.read.parquet(path)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_ROWS)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "source", "size", "doc_id", "tag").checkpoint()
    sums = ranged.mapInArrow(_sums, "part long, source string, words long")
    offset = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("part", F.col("source").alias("s"), offset.alias("offset"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs).withColumnRenamed("source", "s")
    plan = offsets.join(goal.withColumnRenamed("s", "g"), F.col("s").eqNullSafe(F.col("g"))).drop("g").withColumnRenamed("part", "p")  # a row per partition and source
    run = ranged.mapInArrow(_prefix, "part long, source string, size long, doc_id long, tag long, before long")
    out = run.join(plan, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    before = F.col("offset") + F.col("before")
    budget = F.round("target").cast("long")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("source_size") * e - before)) for e in range(1, epochs)), F.greatest(F.lit(0), F.least(F.col("size"), budget - before)))
    return out.select("doc_id", "tag", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op6_mixing": rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source IS NULL, source COLLATE C) - 1) % {len(WEIGHTS)} AS INTEGER) + 1] AS w FROM s),
     o AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM w),
     f AS (SELECT *, CAST(total * {SHARE[0]} - before * {EPOCHS * SHARE[1]} AS DOUBLE) AS spare FROM o),
     l AS (SELECT arg_min(spare / rest, source_size / w) AS level FROM f WHERE spare * w <= source_size * rest * {EPOCHS * SHARE[1]}),
     t AS (SELECT source, source_size, least(source_size * {EPOCHS}.0::DOUBLE, coalesce(level * w / {SHARE[1]}, source_size * {EPOCHS}.0::DOUBLE)) AS target FROM f, l),
     r AS (SELECT d.doc_id, d.size, source_size, target, CAST(round(target) AS BIGINT) AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}|' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST({" + ".join(f"greatest(0, least(size, budget - {e} * source_size - before))" for e in range(EPOCHS))} AS BIGINT) AS taken FROM r
"""
}
