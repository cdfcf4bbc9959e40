"""LM scoring: cross-entropy difference between matched target and background bigram models."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import words as W
from keystrata.llm.exchange import ask, bucket_of, pack, pack_sorted, runs, spread, squeeze, unpack, unpack_sorted, unsqueeze

PRIOR = 4.0  # words of prior mass that a context takes from the unigram model
SHARED = 1000.0  # words of prior mass that the target's unigram model takes from the vocabulary
MOST_HEAVY = 1024  # ids that more than one in so many rows repeat are dealt by their texts
HELD_TYPES = 1 << 20


def _parted(group: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The group's documents in order, and which of them are in the target; rows without text name its ids."""
    is_mark = group.column("text").is_null()
    marks = group.column("doc_id").filter(is_mark).to_numpy()
    docs = group.filter(pc.invert(is_mark)).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = docs.column("doc_id")
    return docs, np.isin(ids.fill_null(0).to_numpy(), marks) & ids.is_valid().to_numpy()


def _grams(group: pa.Table, buckets: int) -> tuple:
    """Rows, places and distinct hashes of a group's unigrams and bigrams, in order of bucket."""
    row, uni, at, bi, base, n = [], [], [], [], 0, 0
    for part in W.slices(group, "text"):
        words = W.split(part.column("text"), lower=True)
        i, h = W.windows(words, 2)
        row.append(words.row + base)
        uni.append(words.hash)
        at.append(i + n)
        bi.append(h)
        base += part.num_rows
        n += len(words.row)
    row, at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (row, at))
    uni, bi = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (uni, bi))
    key, back = np.unique(np.concatenate([uni, bi]), return_inverse=True)
    return row, at, len(uni), key, back, runs(bucket_of(key, buckets))


def _request(group: pa.Table, buckets: int) -> Iterator[tuple[int, bytes]]:
    group, target = _parted(group)
    row, at, n, key, back, asked = _grams(group, buckets)
    inside = target.astype(np.float64)
    weight = np.concatenate([inside[row], inside[row[at]]])
    every = np.bincount(back, minlength=len(key)).astype(np.uint64)
    target = np.bincount(back, weights=weight, minlength=len(key)).astype(np.uint64)
    for bucket, s, e in asked:
        sent = pack_sorted(key[s:e])
        yield bucket, struct.pack("<I", len(sent)) + sent + pack(*squeeze(every[s:e]), *squeeze(target[s:e]))


def _answer(requests: list[bytes]) -> list[bytes]:
    """Counts over the whole corpus and over the target, of every key asked for."""
    parts = []
    for blob in requests:
        end = 4 + struct.unpack_from("<I", blob)[0]
        small, large, near, more = unpack(blob[end:])
        parts.append((unpack_sorted(blob[4:end]), unsqueeze(small, large), unsqueeze(near, more)))
    _, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    every = np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.uint64)[back]
    target = np.bincount(back, weights=np.concatenate([p[2] for p in parts])).astype(np.uint64)[back]
    ends = np.cumsum([len(p[0]) for p in parts])
    return [pack(*squeeze(every[e - len(p[0]) : e]), *squeeze(target[e - len(p[0]) : e])) for p, e in zip(parts, ends, strict=True)]


def _losses(row, at, uni, bi, scale: float, total: float, types: float, base=None) -> tuple[np.ndarray, np.ndarray]:
    """(negative log probability of each word, unigram probabilities); counts times ``scale``."""
    p1 = (uni + 1) / (total + types) if base is None else (uni + SHARED * base) / (total + SHARED)
    p = p1.copy()
    p[at + 1] = (scale * bi + PRIOR * p1[at + 1]) / (scale * uni[at] + PRIOR)
    return -np.log(p), p1


def _finish(group: pa.Table, replies: dict[int, bytes], buckets: int, n_every: int, n_target: int, types: int) -> pa.Table:
    group, inside = _parted(group)
    row, at, n, key, back, asked = _grams(group, buckets)
    every, target = np.empty(len(key)), np.empty(len(key))
    for bucket, s, e in asked:
        told = unpack(replies[bucket])
        every[s:e], target[s:e] = unsqueeze(told[0], told[1]), unsqueeze(told[2], told[3])
    where = np.concatenate([row, row[at]])
    _, again, times = np.unique(where * len(key) + back, return_inverse=True, return_counts=True)
    own = times[again]  # a document is scored by the counts of all others
    every, target = every[back] - own, target[back] - own * inside[where]
    matched = n_target / n_every if n_target else 1.0
    wide, base = _losses(row, at, every[:n], every[n:], matched, n_every, types)
    near, _ = _losses(row, at, target[:n], target[n:], 1.0, n_target, types, base)
    count = np.bincount(row, minlength=group.num_rows)
    mean = lambda x: pa.array(np.bincount(row, weights=x, minlength=group.num_rows) / np.maximum(1, count), mask=count == 0)
    return pa.table({"doc_id": group.column("doc_id"), "n_tokens": pa.array(count, pa.int64()), "target_loss": mean(near), "background_loss": mean(wide), "difference": mean(near - wide)})


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(is_word, v, n): each document's id with its count of words, and the hash of each word that is new to the task."""
    held = np.zeros(0, np.uint64)
    for batch in batches:
        for part in W.slices(batch, "text"):
            words = W.split(part.column("text"), lower=True)
            key = np.unique(words.hash)
            fresh = key[~np.isin(key, held, assume_unique=True)]
            held = np.union1d(held, fresh) if len(held) + len(fresh) <= HELD_TYPES else key
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(fresh), bool)), pa.array(fresh.view(np.int64)), pa.array(np.zeros(len(fresh), np.int64))], ["is_word", "v", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(part.num_rows, bool)), part.column("doc_id"), pa.array(words.counts())], ["is_word", "v", "n"])


def _sizes(rows: DataFrame, ids: DataFrame) -> tuple[int, int, int]:
    """(words of the corpus, words of the target, distinct words), all exact, in one pass over the texts."""
    told = rows.mapInArrow(W.tidy(_tally), "is_word boolean, v long, n long").withColumn("mark", F.lit(False))
    marks = ids.select(F.lit(False).alias("is_word"), F.col("doc_id").alias("v"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("mark"))
    each = told.unionByName(marks).groupBy("is_word", "v").agg(F.sum("n").alias("n"), F.max("mark").alias("mark"))
    got = each.agg(F.sum("n"), F.sum(F.when(F.col("mark"), F.col("n"))), F.count_if("is_word")).first()
    return got[0] or 0, got[1] or 0, got[2]


def _deal(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, int]:
    """Documents, and the target's ids as rows without text, with the group ``g`` of their id; and the count of buckets.

    Ids meet their documents inside the groups, so no text moves for that.  An id that more than
    one in ``MOST_HEAVY`` rows repeat is dealt by its texts, and named to every group if it is in
    the target; there are fewer than ``MOST_HEAVY`` such ids.
    """
    groups, buckets = spread(rows, "text")
    each = rows.where("doc_id is not null").groupBy("doc_id").count()
    total = rows.count()
    heavy = [r.doc_id for r in each.where(F.col("count") > max(1000, total // MOST_HEAVY)).collect()]
    apart = F.col("doc_id").isNull() | F.col("doc_id").isin(heavy)
    by_text = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(groups))
    by_id = F.pmod(F.xxhash64("doc_id"), F.lit(groups))
    marks = ids.select("doc_id", F.lit(None).cast("string").alias("text"), F.explode(F.when(F.col("doc_id").isin(heavy), F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).otherwise(F.array(by_id))).alias("g"))
    return rows.withColumn("g", F.when(apart, by_text).otherwise(by_id)).unionByName(marks), buckets


def lm_scoring(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, target_loss, background_loss, difference.

    ``target`` lists the ids (doc_id) of the target domain; the background is the whole corpus.
    Both bigram models count all their words and share one vocabulary, every word of the corpus,
    lower-cased (A-Z).  They have the same order and smoothing, and background counts are scaled to
    the target's size, so that equal evidence weighs alike.  Losses are nats per word; a low
    difference means that a text is more like the target.  The target's unigrams fall back on the
    vocabulary's distribution, so every probability is above 0.

    Counts are asked for by groups of documents and answered by buckets of n-grams: the tables
    grow with the corpus and are never gathered.  Null texts and texts without words have no
    tokens and null losses; rows that repeat an id count each by itself; a null id is not in the
    target; with an empty target it has the vocabulary's distribution.  An empty table gives an
    empty result; other columns are ignored.
    """
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_every, n_target, types = _sizes(rows, ids)
    dealt, buckets = _deal(rows, ids)
    return ask(
        dealt,
        lambda group: _request(group, buckets),
        _answer,
        lambda group, replies: _finish(group, replies, buckets, n_every, n_target, max(1, types)),
        "doc_id long, n_tokens long, target_loss double, background_loss double, difference double",
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good and not toxic."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    return lm_scoring(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)
