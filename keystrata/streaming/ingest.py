"""Structured Streaming: continuous ingest into a store, and newest-wins state."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keystrata.operators import merge
from keystrata.session import checkpoint_dir


def into_store(stream: DataFrame, store, checkpoint: str, compact_every: int = 0) -> StreamingQuery:
    """Every micro-batch becomes one committed segment; a batch that is replayed is not put twice.

    Batches are known by the id that the checkpoint keeps for its query, so other streams, and one
    that begins anew with another checkpoint, put theirs too.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        named = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        store.put(batch, batch_id=batch_id, stream=named)
        if compact_every and (batch_id + 1) % compact_every == 0:
            store.compact_down()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(stream: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Newest row per key as streaming state; late rows with a smaller sequence lose."""
    return merge.latest(stream, keys, seq)


def latest_once(spark: SparkSession, path: str, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """Drains the files of ``path`` through a stream and returns the final state.

    Every batch writes its whole state to the shared folder; the last one is the answer.
    """
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path if not path.endswith(".parquet") else path + "*")
    seen: list[int] = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{batch_id}")
        seen.append(batch_id)

    query = latest_stream(source, keys, seq).select(*columns).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out/{seen[-1]}")
