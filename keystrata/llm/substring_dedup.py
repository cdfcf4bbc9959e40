"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Repeated windows merge into maximal removal intervals.  See `substring_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import words as W
from keystrata.llm.exchange import ask, deal, pack, runs, unpack

WIDTH = 13


def _ordered(group: pa.Table) -> pa.Table:
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _ranks(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The group's distinct ids in order, and each row's place among them; no id comes after all."""
    none = group.column("doc_id").is_null().to_numpy()
    ids = group.column("doc_id").fill_null(0).to_numpy()
    known, place = np.unique(ids[~none], return_inverse=True)
    ranks = np.full(len(ids), len(known), dtype=np.int64)
    ranks[~none] = place
    return known, ranks


def _keys(group: pa.Table, width: int, buckets: int) -> tuple:
    """The group's windows, its distinct window hashes in order of bucket, document and hash."""
    known, ranks = _ranks(group)
    at, hashes, bucket, row, base = [], [], [], [], 0
    parts = []
    n_words = 0
    for part in W.slices(group, "text"):
        words = W.split(part.column("text"))
        i, h = W.windows(words, width)
        _, h2 = W.windows(words, width, salt=1)
        at.append(i + n_words)
        hashes.append(h)
        bucket.append((h2 % np.uint64(buckets)).astype(np.int64))
        row.append(words.row[i] + base)
        parts.append(words)
        n_words += len(words.row)
        base += part.num_rows
    at, hashes, bucket, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, hashes, bucket, row))
    hashes = hashes.astype(np.uint64)
    key, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    order = np.lexsort((key, row[first], bucket[first]))
    return known, ranks, parts, n_words, at, row, key, first, back, order, bucket


def _request(group: pa.Table, width: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Per bucket: keys in the order of their first documents, and those documents with their counts.

    Only documents that have keys in the bucket are named, so a request costs its keys, however
    many buckets there are.
    """
    known, ranks, _, _, _, row, key, first, _, order, bucket = _keys(_ordered(group), width, buckets)
    b, owner = bucket[first][order], ranks[row[first[order]]]
    for at, s, e in runs(b):
        heads = np.flatnonzero(np.diff(owner[s:e], prepend=-1))
        ids = known[owner[s:e][heads][owner[s:e][heads] < len(known)]]  # no id stands last, unnamed
        counts = np.diff(np.append(heads, e - s)).astype(np.uint64)
        low = int(ids[0]) if len(ids) else 0
        yield at, pack(key[order[s:e]], counts, np.diff(ids, prepend=ids[:1]).astype(np.uint64), np.array([low + 2**63], dtype=np.uint64))


def _answer(requests: list[bytes]) -> list[bytes]:
    """One bit a key: some document with a smaller id than the group's first holder has it too."""
    keys, counts, known, sizes = [], [], [], []
    for blob in requests:
        key, per_doc, steps, low = unpack(blob)
        ids = np.cumsum(steps.astype(np.int64)) + (int(low[0]) - 2**63)
        keys.append(key.astype(np.uint64))
        counts.append(per_doc.astype(np.int64))
        known.append(ids)
        sizes.append(len(key))
    every = np.unique(np.concatenate(known))
    places = [np.append(np.searchsorted(every, ids), len(every))[: len(c)] for ids, c in zip(known, counts, strict=True)]  # no id comes after all
    key, doc = np.concatenate(keys), np.concatenate([np.repeat(p, c) for p, c in zip(places, counts, strict=True)])
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    least = np.minimum.reduceat(doc[order], heads)
    flag = np.empty(len(key), dtype=bool)
    flag[order] = np.repeat(least, np.diff(np.append(heads, len(key)))) < doc[order]
    ends = np.cumsum(sizes)
    return [np.packbits(flag[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]


def _finish(group: pa.Table, replies: dict[int, bytes], width: int, buckets: int) -> pa.Table:
    group = _ordered(group)
    _, ranks, parts, n_words, at, row, key, first, back, order, bucket = _keys(group, width, buckets)
    flag = np.zeros(len(key), dtype=bool)
    b = bucket[first][order]
    for asked, s, e in runs(b):
        flag[order[s:e]] = np.unpackbits(np.frombuffer(replies[asked], np.uint8), count=e - s).astype(bool)
    repeated = at[flag[back] | (ranks[row] > ranks[row[first]][back])] if len(at) else at
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + width, -1)
    gone = np.cumsum(edge[:-1]) > 0
    n, removed, spans, texts, base = [], [], [], [], 0
    for words in parts:
        data = words.data.tobytes()
        for s, e in zip(words.row_starts()[:-1].tolist(), words.row_starts()[1:].tolist(), strict=True):
            cut = gone[base + s : base + e]
            step = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8)))
            spans.append([{"first_word": int(x), "end_word": int(y)} for x, y in step.reshape(-1, 2)])
            keep = np.flatnonzero(~cut) + s
            texts.append(b" ".join([data[x:y] for x, y in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)]).decode())
            n.append(e - s)
            removed.append(int(cut.sum()))
        base += len(words.row)
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))
    return pa.table({"doc_id": group.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, span), "kept_text": pa.array(texts, pa.string())})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Removes every word covered by a ``width``-word window that also starts in a smaller id.

    Returns one row per input row: doc_id, n_words, n_removed, removed (maximal half-open word
    intervals) and kept_text (kept words joined by one space).

    Windows are matched by a 64-bit polynomial hash inside a bucket that a second, independent
    hash chooses, so the chance that a window meets a false partner is (keys of a bucket) / 2**64
    whatever the size of the corpus.

    Null or empty texts and texts shorter than a window lose nothing.  Rows that repeat an id count
    as one document: they never remove each other's words.  Rows without an id are one document too,
    after all others.  An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt, buckets = deal(rows, "doc_id", "text")
    return ask(
        dealt,
        lambda group: _request(group, width, buckets),
        _answer,
        lambda group, replies: _finish(group, replies, width, buckets),
        "doc_id long, n_words long, n_removed long, removed array<struct<first_word:long,end_word:long>>, kept_text string",
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


SQL = {
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
     g AS (SELECT doc_id, i, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM w WHERE len(w) >= {WIDTH})),
     f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
     gone AS (SELECT DISTINCT doc_id, i + j AS p FROM g JOIN f ON g.k = f.k, range(0, {WIDTH}) r(j) WHERE least < doc_id),
     each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
     kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) AS t FROM each e ANTI JOIN gone ON e.doc_id = gone.doc_id AND e.p = gone.p GROUP BY e.doc_id),
     n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
}
