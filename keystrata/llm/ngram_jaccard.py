"""N-gram Jaccard join by parity sketches, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import words as W
from keystrata.llm.exchange import ask, bucket_of, deal, pack_sorted, runs, unpack_sorted
from keystrata.session import checkpoint_dir, release

WIDTH = 5
# Documents link when 100 * |A & B| >= 80 * |A | B|; so |A xor B| <= (|A| + |B|) / 9.
THRESHOLD = 80
SAMPLE_ROWS, HEAVY_SHARE, MOST_HEAVY = 20_000, 0.001, 1 << 16
# Bits of a whole-set sketch: eight to four a shingle, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 9, 1 << 12
# Nodes of a key in one block, and rows (with their sketches) in one group of blocks.
BLOCK_NODES, GROUP_ROWS = 512, 8192


def shingle_sets(words: W.Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted by row and hash; a shorter text is one shingle."""
    at, h = W.windows(words, width)
    row = words.row[at]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        start = words.row_starts()[short]
        own = np.zeros(len(short), dtype=np.uint64)
        for j in range(width - 1):
            has = counts[short] > j
            own[has] = W.mix(own[has] + words.hash[start[has] + j] * W._COEF[2, j])
        row, h = np.concatenate([row, short]), np.concatenate([h, own])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _distance(n: np.ndarray, partner: np.ndarray) -> np.ndarray:
    return (n + partner) // 9


def sketch_keys(row: np.ndarray, h: np.ndarray, n_rows: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the sketch blocks by which a document finds its partners.

    A sketch is a row of bits; a shingle flips one.  At the level of a size band, [2**j, 2**(j+1))
    and the partners above it, the bits are dealt into k blocks, with k above the largest distance
    d that a link allows there.  A shingle of one set only changes one block, so linked sets agree
    in k - d blocks at least, and after ordering all blocks alike (most shingles that are not
    frequent first), within the first d + 1 of each.  A key names level, block, the block's bits
    (as the XOR of a random word per set bit) and that count.
    """
    n = np.bincount(row, minlength=n_rows).astype(np.int64)
    rare = np.ones(len(h), dtype=np.int64)
    if len(heavy):
        rare[heavy[np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)] == h] = 0
    band = np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64), -1)
    out_row, out_key = [], []
    for down in (0, 1):  # as the smaller or an equal of a pair; as the larger, one band below
        low = np.left_shift(1, np.maximum(band, 0))
        live = (n > 0) if not down else (n > 1) & (-(-4 * n // 5) <= low - 1)
        if not live.any():
            continue
        level = band - down
        top = np.left_shift(1, np.maximum(level, 0) + 1) - 1
        most = _distance(top, 5 * top // 4)
        k = most + 1 + most // 8
        need = _distance(n, np.minimum(5 * n // 4, low - 1) if down else 5 * n // 4) + 1
        use = live[row]
        r, x, light = row[use], h[use], rare[use]
        block = (W.mix(x + np.uint64(77)) % k[r].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((block, r))
        r, block, bits, light = r[order], block[order], W.mix(x[order] ^ np.uint64(0xA5A5A5A5)), light[order]
        heads = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (block[1:] != block[:-1])]))
        word, count = np.bitwise_xor.reduceat(bits, heads), np.add.reduceat(light, heads)
        r, block = r[heads], block[heads]
        tag = lambda w, b, c, lv: W.mix(w + W.mix((b * 4096 + c * 64 + lv).astype(np.uint64) + np.uint64(1)))
        key = tag(word, block, np.minimum(count, 63), level[r])
        order = np.lexsort((key, -count, r))
        r2, key2 = r[order], key[order]
        begin = np.searchsorted(r2, np.arange(n_rows))
        place = np.arange(len(r2)) - begin[r2]
        first = place < need[r2]
        out_row.append(r2[first])
        out_key.append(key2[first])
        filled = np.bincount(r, minlength=n_rows)
        for i in np.flatnonzero(live & (filled < need)).tolist():  # empty blocks come last, and count too
            free = np.setdiff1d(np.arange(k[i]), block[r == i])
            zero = np.zeros(len(free), np.int64)
            empty = np.sort(tag(zero.astype(np.uint64), free, zero, level[i]))[: need[i] - filled[i]]
            out_row.append(np.full(len(empty), i))
            out_key.append(empty)
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_key)


def parity_sketch(h: np.ndarray) -> bytes:
    """The set's parity sketch: every shingle flips one bit, so the Hamming distance of two sketches
    is at most the symmetric difference of their sets."""
    bits = min(MOST_BITS, max(LEAST_BITS, 8 << (len(h).bit_length() - 1)))
    at = (W.mix(h ^ np.uint64(0x3C3C3C3C3C3C3C3C)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1).tobytes()


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, each halved by XOR until it has ``size`` bytes."""
    out = np.empty((len(sketches), size // 8), dtype=np.uint64)
    for i, x in enumerate(sketches):
        bits = np.frombuffer(x, dtype=np.uint64)
        while len(bits) > size // 8:
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
        out[i] = bits
    return out


def _frequent(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            _, h = shingle_sets(W.split(part.column("text"), lower=True), width)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])


def _ordered(group: pa.Table) -> pa.Table:
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _keyed(group: pa.Table, width: int, heavy: np.ndarray) -> Iterator[tuple]:
    for part in W.slices(group, "text"):
        row, h = shingle_sets(W.split(part.column("text"), lower=True), width)
        yield part, row, h, *sketch_keys(row, h, part.num_rows, heavy)


def _group_keys(parts: list[tuple], buckets: int) -> tuple:
    """Distinct keys of a group in order of bucket, how often it holds them, and the run of each bucket."""
    every = np.concatenate([p[4] for p in parts]) if parts else np.zeros(0, np.uint64)
    key, times = np.unique(every, return_counts=True)
    return key, times, runs(bucket_of(key, buckets))


def _request(group: pa.Table, width: int, heavy: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    key, _, asked = _group_keys(list(_keyed(group, width, heavy)), buckets)
    for bucket, s, e in asked:
        yield bucket, pack_sorted(key[s:e])


def _answer(requests: list[bytes]) -> list[bytes]:
    """One bit a key: another group holds it too."""
    keys = [unpack_sorted(x) for x in requests]
    _, back, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    flag, ends = times[back] > 1, np.cumsum([len(k) for k in keys])
    return [np.packbits(flag[e - len(k) : e]).tobytes() for k, e in zip(keys, ends, strict=True)]


def _finish(group: pa.Table, replies: dict[int, bytes], width: int, heavy: np.ndarray, buckets: int) -> pa.Table:
    """Every document's size and set digest; keys that are shared, and the set, where there are any."""
    parts = list(_keyed(_ordered(group), width, heavy))
    key, times, asked = _group_keys(parts, buckets)
    shared = times > 1
    for bucket, s, e in asked:
        shared[s:e] |= np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=e - s).astype(bool)
    known = np.sort(key[shared])
    ids, n, sid, keys, sets, sketches = [], [], [], [], [], []
    for part, row, h, krow, k in parts:
        hit = known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k if len(known) else np.zeros(len(k), bool)
        order = np.argsort(krow[hit], kind="stable")
        krow, k = krow[hit][order], k[hit][order].view(np.int64)
        at, kat = np.searchsorted(row, np.arange(part.num_rows + 1)), np.searchsorted(krow, np.arange(part.num_rows + 1))
        for i in range(part.num_rows):
            own, mine = h[at[i] : at[i + 1]], k[kat[i] : kat[i + 1]]
            n.append(len(own))
            sid.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            keys.append(np.unique(mine))
            sets.append(own.view(np.int64) if len(mine) else None)
            sketches.append(parity_sketch(own) if len(mine) else None)
        ids.append(part.column("doc_id"))
    longs = pa.list_(pa.int64())
    doc = pa.chunked_array([c for col in ids for c in (col.chunks if isinstance(col, pa.ChunkedArray) else [col])], pa.int64())
    tags = np.array([xxhash.xxh64_intdigest(t.as_buffer() or b"", 42) for p in parts for t in p[0].column("text")], dtype=np.uint64).view(np.int64)  # as Spark's xxhash64
    return pa.table({"doc_id": doc, "tag": pa.array(tags), "n": pa.array(n, pa.int64()), "sid": pa.array(sid, pa.binary()), "keys": pa.array(keys, longs), "shingles": pa.array(sets, longs), "sketch": pa.array(sketches, pa.binary())})


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the least node that it reaches.

    Each round takes the least label of the neighbours and then the label's own label; rounds are
    checkpointed, and the driver only sees whether a label changed.  Labels only fall, so rounds end
    by themselves; a chain of links may take rounds in proportion to its length.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a"))).distinct().checkpoint()
    label = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l")).checkpoint()
    while True:
        near = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("m"))
        moved = label.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        far = moved.select(F.col("u").alias("m"), F.col("m").alias("mm"))
        after = moved.join(far, "m").select("u", "l", F.least("m", "mm").alias("m")).checkpoint()
        changed = after.where("m <> l").limit(1).count()
        label = after.select("u", F.col("m").alias("l"))
        if not changed:
            return label.select(F.col("u").alias("node"), F.col("l").alias("label"))


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches are no further apart than a link allows."""
    for batch in batches:
        a, b = batch.column("ka").to_pylist(), batch.column("kb").to_pylist()
        most = _distance(np.asarray(batch.column("na")), np.asarray(batch.column("nb")))
        size = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype=np.int64)
        keep = np.zeros(len(a), dtype=bool)
        for z in np.unique(size).tolist():
            at = np.flatnonzero(size == z)
            far = np.bitwise_count(_folded([a[i] for i in at], z) ^ _folded([b[i] for i in at], z)).sum(1)
            keep[at] = far <= most[at]
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _close_blocks(group: pa.Table) -> pa.Table:
    """Pairs (a, b) of different labels in two blocks of a key that sizes and sketches allow to link."""
    group = group.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
    key, i, j, block, n, label = (group.column(c).to_numpy() for c in ("key", "i", "j", "block", "n", "label"))
    sid, sketch = group.column("sid").to_pylist(), group.column("sketch").to_pylist()
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    cuts = [*np.flatnonzero(new).tolist(), len(key)]
    found = set()
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if i[s] == j[s]:
            left = right = np.arange(s, e)
        else:
            left, right = s + np.flatnonzero(block[s:e] == i[s]), s + np.flatnonzero(block[s:e] == j[s])
        if not len(left) or not len(right):
            continue
        size = min(len(sketch[x]) for x in range(s, e))
        ours, theirs = _folded([sketch[x] for x in left], size), _folded([sketch[x] for x in right], size)
        step = max(1, (1 << 20) // theirs.size)
        for at in range(0, len(left), step):
            part = left[at : at + step]
            far = np.bitwise_count(ours[at : at + step, None] ^ theirs[None]).sum(2, dtype=np.int64)
            na, nb = n[part][:, None], n[right][None]
            good = (far <= _distance(na, nb)) & (label[part][:, None] != label[right][None]) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb))
            for x, y in zip(*np.nonzero(good), strict=True):
                found.add((min(sid[part[x]], sid[right[y]]), max(sid[part[x]], sid[right[y]])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def _apart(held: DataFrame, label: DataFrame, kept: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that share a key, have different labels and pass the sketches.

    A key's nodes are split into those of its largest label and the others, both into blocks of
    ``BLOCK_NODES``; others meet all blocks, and the largest label none of its own.  Pairs are
    compared inside a task, block against block, and only those that pass become rows.
    """
    named = label.withColumnRenamed("node", "sid").withColumnRenamed("label", "l")
    rows = held.where("c > 2").join(named, "sid", "left").select("key", "sid", "n", F.xxhash64(F.coalesce("l", "sid")).alias("label"))
    each = rows.groupBy("key", "label").agg(F.count("*").alias("m"))
    split = each.groupBy("key").agg(F.sum("m").alias("c"), F.max("m").alias("main"), F.max_by("label", F.struct("m", "label")).alias("top")).where("c > main")
    many = lambda x: F.when(F.col("c") <= BLOCK_NODES, 1).otherwise(F.ceil(x / BLOCK_NODES)).cast("int")
    dealt = rows.join(split.select("key", "c", "top", many(F.col("c") - F.col("main")).alias("others"), many(F.col("main")).alias("mains")), "key")
    dealt = dealt.withColumn("is_main", (F.col("label") == F.col("top")) & (F.col("c") > BLOCK_NODES))
    dealt = dealt.withColumn("block", F.when(F.col("is_main"), F.col("others") + F.pmod(F.xxhash64("sid"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("sid"), F.col("others"))).cast("int"))
    last = F.when(F.col("is_main") | (F.col("c") <= BLOCK_NODES), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    dealt = dealt.select("key", "sid", "n", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).checkpoint()
    groups = max(1, -(-dealt.count() // GROUP_ROWS))
    full = dealt.join(kept.select("sid", "sketch"), "sid").withColumn("g", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))
    return full.groupBy("g").applyInArrow(_close_blocks, "a binary, b binary").distinct()


def _verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets link; exact, on the sets themselves.

    Only sets of nodes in ``pairs`` pass the first exchange, one per node; the second moves one set
    per pair.
    """
    asked = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    sets = found.where(F.col("shingles").isNotNull()).select("sid", "shingles").join(asked, "sid", "left_semi").groupBy("sid").agg(F.first("shingles").alias("shingles"))
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    full = pairs.join(right, "b").join(left, "a").select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return full.where(100 * F.col("i") >= THRESHOLD * (F.col("n") - F.col("i"))).select("a", "b")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, tag, n, c.  ``tag`` is xxhash64 of the text, null counting as
    empty; ``c`` names the component and is null for texts without words.  See `ngram_jaccard`.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Frequent shingles only set the order of blocks: any list gives the same links.
    total = docs.count()
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // SAMPLE_ROWS))) == 0)
    often = sample.mapInArrow(W.tidy(lambda it: _frequent(it, width)), "h long").groupBy("h").count().where(F.col("count") >= max(8, HEAVY_SHARE * min(total, SAMPLE_ROWS)))
    heavy = np.sort(often.orderBy(F.desc("count"), "h").limit(MOST_HEAVY).select("h").toArrow().column("h").to_numpy().view(np.uint64))
    dealt, buckets = deal(rows, "doc_id", "text")
    found = ask(
        dealt,
        lambda group: _request(group, width, heavy, buckets),
        _answer,
        lambda group, replies: _finish(group, replies, width, heavy, buckets),
        "doc_id long, tag long, n long, sid binary, keys array<long>, shingles array<long>, sketch binary",
    ).checkpoint()
    release(spark)  # the texts and requests
    nodes = found.where(F.size("keys") > 0).select("sid", "n", "keys", "doc_id", "sketch").groupBy("sid").agg(F.first("n").alias("n"), F.min_by("keys", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("keys"), F.first("sketch").alias("sketch")).checkpoint()
    kept = nodes.select("sid", "n", "sketch")
    held = nodes.select("sid", "n", F.explode("keys").alias("key"))
    several = held.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    held = held.join(several, "key").checkpoint()
    hub = held.groupBy("sid").agg(F.sum("c").alias("weight"))
    placed = held.join(hub, "sid")
    hubs = placed.groupBy("key").agg(F.max(F.struct("weight", "sid", "n")).alias("hub")).select("key", F.col("hub.sid").alias("a"), F.col("hub.n").alias("na"))
    near = 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")
    star = held.withColumnsRenamed({"sid": "b", "n": "nb"}).join(hubs, "key").where((F.col("a") != F.col("b")) & near).select("a", "b").distinct().checkpoint()
    close = star.join(kept.toDF("a", "na", "ka"), "a").join(kept.toDF("b", "nb", "kb"), "b").mapInArrow(W.tidy(_close_pairs), "a binary, b binary").checkpoint()
    release(spark)
    links = _verified(close, found).checkpoint()
    label = components(links)
    # What a key still holds apart: pairs across components that were not compared yet.
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = _apart(held, label, kept).join(done, ["a", "b"], "left_anti").checkpoint()
    if rest.limit(1).count():
        more = _verified(rest, found).checkpoint()
        label = components(links.union(more))
    return found.select("doc_id", "tag", "n", "sid").join(label.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "tag", "n", F.coalesce("label", "sid").alias("c"))


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z); a set is the distinct ``width``-word shingles, or the whole
    sequence of a shorter text.  Sets of equal content are one node.  Nodes that share a sketch key
    are first compared with the key's hub, the node that shares most keys in all; what stays apart
    within a key is then compared by whole-set sketches in blocks, and only pairs that those leave
    are verified on the sets.  No link between different sets is lost, and a group of near copies
    costs about one verified comparison each.

    Null texts and texts without words link with nothing and are their own component.  Rows that
    repeat an id, or have none, are one by one nodes or copies like other rows.  A null id comes after
    all others: it is component_id only of rows without an id that link with no row that has one.  An
    empty table gives an empty result; other columns are ignored.
    """
    named = linked(docs, id_col, text_col, width)
    least = named.where(F.col("c").isNotNull()).groupBy("c").agg(F.min("doc_id").alias("least"))
    return named.join(least, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
