"""Line dedup: range-partitioned line hashes with a secondary sort by document and position.

First occurrences are streamed; what comes back is one keep bitmap per document, not text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.words import tidy
from keystrata.session import checkpoint_dir

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 10


def _keys(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(high, low, none, doc_id, tag, pos) of every line whose key is long enough; two 64-bit hashes of it.

    ``none`` is 1, and doc_id 0, for a row without an id.
    """
    key = lambda x: F.translate(F.btrim(x, F.lit(BLANK)), UPPER, LOWER)
    doc = F.col(id_col).cast("long")
    named = docs.select(doc.isNull().cast("byte").alias("none"), F.coalesce(doc, F.lit(0)).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    long = named.select("none", "doc_id", "tag", "pos", key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return long.select(F.xxhash64("key").alias("high"), F.xxhash64(F.lit("low"), F.col("key")).alias("low"), "none", "doc_id", "tag", "pos")


def _documents(none: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(none, doc_id) of each row."""
    return np.stack([none.astype(np.int64), doc], axis=1)


def _keeper(arrays: tuple, carry: tuple) -> tuple[np.ndarray, np.ndarray]:
    """First document of each row's run; ``carry`` is (high, low, first doc) of the run before."""
    high, low, doc = arrays
    head = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    starts = np.flatnonzero(head)
    first = doc[starts].copy()
    if carry is not None and (high[0], low[0]) == carry[:2]:
        first[0] = carry[2]
    return np.repeat(first, np.diff(np.append(starts, len(doc))), axis=0), starts


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: first key, last key and the first document seen for the last key."""
    first = last = None
    part = -1
    for batch in batches:
        if not batch.num_rows:
            continue
        part, high, low, none, doc = (batch.column(i).to_numpy() for i in range(5))
        keeper, _ = _keeper((high, low, _documents(none, doc)), last)
        first = first or (int(high[0]), int(low[0]))
        last, part = (int(high[-1]), int(low[-1]), tuple(keeper[-1].tolist())), int(part[0])
    if last:
        yield pa.RecordBatch.from_pydict({"part": [part], "fh": [first[0]], "fl": [first[1]], "lh": [last[0]], "ll": [last[1]], "none": [last[2][0]], "doc": [last[2][1]]})


def _dropped(batches: Iterator[pa.RecordBatch], carries: dict) -> Iterator[pa.RecordBatch]:
    last, begun = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        part, high, low, none, doc, tag, pos = (batch.column(i).to_numpy() for i in range(7))
        own = _documents(none, doc)
        if not begun:
            last, begun = carries.get(int(part[0])), True
        keeper, _ = _keeper((high, low, own), last)
        last = (int(high[-1]), int(low[-1]), tuple(keeper[-1].tolist()))
        gone = np.flatnonzero((keeper != own).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(none[gone]), pa.array(doc[gone]), pa.array(tag[gone]), pa.array(pos[gone])], ["none", "doc_id", "tag", "pos"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, n_dropped, keep) of a partition sorted by none, doc_id, tag and pos; all distinct.

    Bit *p* of ``keep`` (least significant first) is 0 if line *p* goes; it ends with the byte of
    the last drop.
    """
    held = np.zeros((4, 0), np.int64)

    def made(rows: np.ndarray) -> pa.RecordBatch:
        none, doc, tag, pos = rows
        head = np.ones(len(doc), bool)
        head[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
        starts = np.flatnonzero(head)
        last = np.append(starts[1:], len(doc)) - 1
        ends = np.concatenate([[0], np.cumsum(pos[last] // 8 + 1)])
        bits = np.full(int(ends[-1]), 255, np.uint8)
        np.bitwise_and.at(bits, np.repeat(ends[:-1], last - starts + 1) + pos // 8, ~np.left_shift(1, pos % 8).astype(np.uint8))
        keep = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(bits)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(doc[starts], mask=none[starts] == 1), pa.array(tag[starts]), pa.array(last - starts + 1), keep], ["doc_id", "tag", "n_dropped", "keep"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])], axis=1)
        if not rows.shape[1]:
            continue
        same = (rows[:3] == rows[:3, -1:]).all(axis=0)
        cut = rows.shape[1] - int(np.argmin(same[::-1]) if not same.all() else len(same))  # the last document may go on
        held = rows[:, cut:]
        if cut:
            yield made(rows[:, :cut])
    if held.shape[1]:
        yield made(held)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """Finds lines that also stand in a document with a smaller id.

    Returns (doc_id, tag, n_dropped, keep) for the documents that lose lines: ``keep`` is a bitmap
    of lines, least significant bit first, up to the last dropped line (later lines stay); ``tag``
    is Spark's xxhash64() of the text.

    A hot line is spread over many range partitions, since the range key goes on with document and
    position; the driver carries one summary row per partition across their borders.  The sorted
    keys are checkpointed, because a range partitioning can't be drawn again alike.

    Null or empty texts are one empty line, which never counts.  Rows that repeat an id are one
    document and never drop each other's lines; ``tag`` tells their texts apart.  Rows without an id
    are one document too, after all others.  An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/line-keys-{uuid.uuid4().hex}"
    _keys(docs, id_col, text_col, least_chars).write.parquet(path)  # drawing ranges would work them out twice
    keys = spark.read.parquet(path)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys.count() // 500_000)
    order = ["high", "low", "none", "doc_id", "pos"]
    ranged = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "high", "low", "none", "doc_id", "tag", "pos")
    ranged = ranged.checkpoint()
    edges = ranged.mapInArrow(_edges, "part long, fh long, fl long, lh long, ll long, none long, doc long").orderBy("part").collect()  # one row a partition
    carries, run = {}, None
    for e in edges:
        same = run is not None and (e.fh, e.fl) == run[:2]
        if same:
            carries[e.part] = run
        one_key = (e.fh, e.fl) == (e.lh, e.ll)
        run = (e.lh, e.ll, run[2] if same and one_key else (e.none, e.doc))
    gone = ranged.mapInArrow(tidy(lambda it: _dropped(it, carries)), "none byte, doc_id long, tag long, pos int").distinct()  # repeated rows repeat their drops
    sorted_ = gone.repartition("none", "doc_id", "tag").sortWithinPartitions("none", "doc_id", "tag", "pos")
    return sorted_.mapInArrow(tidy(_bitmaps), "doc_id long, tag long, n_dropped long, keep binary")


def _kept(lines: Column, keep: Column) -> Column:
    """The lines whose bit in ``keep``, or no bit, says that they stay; in the JVM, so that no batch holds texts."""
    digits = F.split(F.hex(keep), "")  # bit p lies in digit (p >> 2) ^ 1, as a byte's high half comes first
    stays = lambda d, i: F.bit_get(F.instr(F.lit("0123456789ABCDEF"), F.get(d, F.shiftright(i, 2).bitwiseXOR(1))) - 1, i.bitwiseAND(3))
    some = F.transform(F.array(digits), lambda d: F.filter(lines, lambda _, i: F.coalesce(stays(d, i), F.lit(1)) == 1))  # digits are made once a row
    return F.array_join(F.get(some, 0), "\n")


def apply_line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """All rows, and all columns but the text, with n_dropped, n_lines and kept_text.

    A row that loses nothing keeps its text, null included.
    """
    maps = line_dedup(docs, id_col, text_col, least_chars)
    rest = [c for c in docs.columns if c not in (text_col, "n_dropped", "n_lines", "kept_text")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_tag"))
    both = rows.join(maps, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_tag") == F.col("tag")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(_kept(lines, F.col("keep")))
    return both.select("rest.*", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.size(lines).cast("long").alias("n_lines"), kept.alias("kept_text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL = {
    "op2_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
     k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
     f AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (least < k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (least IS NULL OR least >= k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""
}
