"""Packed lookup exchange: ask a question about every n-gram of a corpus without moving text twice.

Documents are dealt into groups of a few MB.  Each group sends, per bucket of the key space, one
packed request with its *distinct* keys; the bucket answers with one packed reply in the same
order; the group reads the replies next to its own texts.  A key that a third of all documents
holds therefore costs one entry per group, not one per document, and no task holds more than one
bucket or one group.  Both counts grow with the bytes of the input.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.words import give_back

GROUP_BYTES = 4 << 20
BUCKET_BYTES = 6 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, each in the narrowest type that holds its largest value."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        if a.dtype != np.uint64 or (len(a) and int(a.max()) < 2**32):
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)
        out += [struct.pack("<BQ", a.dtype.itemsize, len(a)), a.tobytes()]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    at, out = 1, []
    for _ in range(blob[0]):
        size, n = struct.unpack_from("<BQ", blob, at)
        at += 9
        out.append(np.frombuffer(blob, dtype=f"<u{size}", count=n, offset=at))
        at += size * n
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit hash: equal ranges of hashes, so that sorted keys are in the order of their buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of six bytes; the few larger ones add their high part."""
    step = np.diff(keys, prepend=keys[:1])
    high = step >> np.uint64(48)
    large = np.flatnonzero(high)
    low = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()
    return pack(keys[:1], low, large.astype(np.uint64), high[large])


def unpack_sorted(blob: bytes) -> np.ndarray:
    first, low, large, high = unpack(blob)
    step = np.zeros((len(low) // 6, 8), np.uint8)
    step[:, :6] = low.reshape(-1, 6)
    step = step.ravel().view("<u8").astype(np.uint64)
    step[large.astype(np.int64)] += high.astype(np.uint64) << np.uint64(48)
    return np.cumsum(step) + first.astype(np.uint64)[: len(step)].sum(dtype=np.uint64)


def squeeze(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as one byte each, 255 standing for the next of the large ones."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint64), counts[large].astype(np.uint64)


def unsqueeze(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.uint64)
    out[small == 255] = large
    return out


def runs(sorted_values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_values)), bool), sorted_values[1:] != sorted_values[:-1]])).tolist()
    return [(int(sorted_values[s]), s, e) for s, e in zip(cuts, [*cuts[1:], len(sorted_values)])]


def spread(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Counts of groups and buckets; one narrow pass measures the bytes of text, so that both follow the input."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // GROUP_BYTES)), max(least, -(-total // BUCKET_BYTES))


def deal(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Adds the group number ``g``; returns also the count of buckets."""
    groups, buckets = spread(docs, text_col)
    of_text = F.when(F.col(id_col).isNull(), F.xxhash64(text_col))  # rows without an id go apart too
    g = F.pmod(F.xxhash64(F.col(id_col), F.octet_length(text_col), of_text), F.lit(groups))
    return docs.withColumn("g", g), buckets


def ask(
    docs: DataFrame,
    request: Callable[[pa.Table], Iterator[tuple[int, bytes]]],
    answer: Callable[[list[bytes]], list[bytes]],
    finish: Callable[[pa.Table, dict[int, bytes]], pa.Table],
    schema: str,
) -> DataFrame:
    """Runs the exchange over ``docs`` (with column ``g``).

    request(group) yields (bucket, packed keys); answer(requests of one bucket) returns a reply to
    each; finish(group, replies by bucket) makes the output rows.  ``request`` and ``finish`` see
    the same rows of a group, in an order of their own choice.
    """

    def send(group: pa.Table) -> pa.Table:
        got = list(request(group))
        g = group.column("g")[0].as_py()
        give_back()
        return pa.table(
            {"g": pa.array([g] * len(got), pa.int64()), "bucket": pa.array([b for b, _ in got], pa.int64()), "req": pa.array([x for _, x in got], pa.binary())}
        )

    def reply(bucket: pa.Table) -> pa.Table:
        told = pa.array(answer(bucket.column("req").to_pylist()), pa.binary())
        give_back()
        return pa.table({"g": bucket.column("g"), "bucket": bucket.column("bucket"), "rep": told})

    def close(group: pa.Table, replies: pa.Table) -> pa.Table:
        out = finish(group, dict(zip(replies.column("bucket").to_pylist(), replies.column("rep").to_pylist(), strict=True)))
        give_back()
        return out

    asked = docs.groupBy("g").applyInArrow(send, "g long, bucket long, req binary")
    told = asked.groupBy("bucket").applyInArrow(reply, "g long, bucket long, rep binary")
    return docs.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(close, schema)
