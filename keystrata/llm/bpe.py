"""Byte-level BPE: ranked merges as a fold of higher-order functions, and decoding.

A task spells each word it meets for the first time as an array of ids of bytes, and of pairs of
bytes that are sure to merge; the JVM folds the ranked merges over it, and a second worker of the same task puts the folded ids in the places of
the words.  All three follow each other in one task: nothing is shuffled, sampled or sent to the
driver, and every word of every text goes through the fold.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import words as W

RANKS = "byte_bpe_multi_50k.tiktoken"
SLICE_PIECES = 1 << 17
HELD_WORDS = 1 << 20  # distinct words a task holds before it starts anew
TASK_BYTES = 128 << 20  # of the scan, for a task: Spark's own default; smaller splits are read together, as a task folds each of its words once
LONG_BYTES = 512  # words above this are merged by a heap, since a fold's time grows with the square of a word
ROW_WORDS = 1 << 8
ROW_PIECES = 1 << 7  # pieces of a text in one row on the way to the workers, which get rows by the ten thousand
REST_PIECES = 1 << 21  # after so many, a worker gives freed memory back
NONE = 1 << 16  # above every rank


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Literal rank map from a pair of ids to the merged id, as a sparse table of shifted rows.

    The row of a left id begins at its shift; rows lie in each other's gaps, and an entry names its
    left id, so two array reads find or rule out a pair.
    """

    def __init__(self, ranks: dict[bytes, int]):
        rows: dict[int, list[tuple[int, int]]] = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if (left := ranks.get(t[:i])) is not None and (right := ranks.get(t[i:])) is not None:
                    rows.setdefault(left, []).append((right, r))
        if max(ranks.values()) >= 65535:
            raise ValueError("PairTable: ids must be below 65,535")
        self.shift = np.full(1 << 16, -NONE, np.int64)
        self.table = np.full(1 << 12, -1, np.int64)
        low = 0
        for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(row) == 1:
                break
            right, rank = np.array(sorted(row), np.int64).T
            low, at = self._fit(low, right - right[0])
            self.table[at + right - right[0]] = left << 16 | rank
            self.shift[left] = at - right[0]
        single = np.array([(left, *row[0]) for left, row in rows.items() if len(row) == 1], np.int64).reshape(-1, 3)
        self._reach(len(self.table) + len(single))
        at = np.flatnonzero(self.table < 0)[: len(single)]
        self.table[at] = single[:, 0] << 16 | single[:, 2]
        self.shift[single[:, 0]] = at - single[:, 1]
        self.table = self.table[: 1 + int(np.flatnonzero(self.table >= 0).max(initial=0))]

    def _reach(self, n: int) -> None:
        if n > len(self.table):
            self.table = np.concatenate([self.table, np.full(n, -1, np.int64)])

    def _fit(self, low: int, right: np.ndarray) -> tuple[int, int]:
        """(where the next search begins, first place from ``low`` on where the row meets no other)."""
        start, width = low, 256
        while True:
            self._reach(low + width + int(right[-1]) + 1)
            at = low + np.flatnonzero(self.table[low : low + width] < 0)
            for k in range(0, len(at), 256):
                free = (self.table[at[k : k + 256, None] + right] < 0).all(axis=1)
                if free.any():
                    return (low if low - start > 4000 else start), int(at[k + np.argmax(free)])
            low, width = low + width, min(4096, width * 2)

    def bound(self, f) -> Column:
        """f(rank), where rank(a, b) looks a pair up; the literals stand in the plan once."""
        shifts, entries = _longs(self.shift), _longs(np.where(self.table < 0, 65535 << 16, self.table))

        def rank(shift: Column, table: Column, a: Column, b: Column) -> Column:
            """What differs from the left id leaves high bits; least() skips a place outside the table."""
            return F.least(F.get(table, F.get(shift, a) + b).bitwiseXOR(F.shiftleft(a.cast("bigint"), 16)), F.lit(NONE).cast("bigint"))

        return _let(shifts, lambda s: _let(entries, lambda t: f(lambda a, b: rank(s, t, a, b))))


def _longs(values: np.ndarray) -> Column:
    """A literal array<bigint>, packed: other literals of arrays or text write all their values into
    every string of a plan, of which the driver makes several a run and keeps some."""
    jvm, gateway = SparkContext._active_spark_context._jvm, SparkContext._active_spark_context._gateway
    held = gateway.new_array(jvm.long, len(values))
    jvm.java.nio.ByteBuffer.wrap(bytearray(values.astype(">i8").tobytes())).asLongBuffer().get(held)
    catalyst = jvm.org.apache.spark.sql.catalyst.expressions
    literal = catalyst.Literal(catalyst.UnsafeArrayData.fromPrimitiveArray(held), jvm.org.apache.spark.sql.types.DataType.fromDDL("array<bigint>"))
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def _let(x: Column, f) -> Column:
    return F.get(F.transform(F.array(x), f), 0)


def merge_fold(parts: Column, rank) -> Column:
    """Folds ranked merges over an array of byte ids: the leftmost pair of least rank merges first.

    The state is one number per token: rank of the pair it begins, place of its first byte, id, in
    this order of weight, so that the least number is the pair to merge.  A merge looks up only the
    two pairs that are new.  An entry that begins no pair stands in front.
    """
    front = F.lit(NONE << 40 | 65535).cast("bigint")
    high = lambda x: F.shiftleft(x, 40)
    id_of = lambda e: e.bitwiseAND(65535).cast("int")

    def merged(s: Column, m: Column, q: Column) -> Column:
        left, new = F.get(s, q - 2), F.shiftright(m, 40).cast("int")
        before = high(rank(id_of(left), new)).bitwiseOR(left.bitwiseAND((1 << 40) - 1))
        here = high(rank(new, id_of(F.get(s, q + 1)))).bitwiseOR(m.bitwiseAND(((1 << 40) - 1) ^ 65535)).bitwiseOR(new.cast("bigint"))
        return F.flatten(F.array(F.slice(s, 1, q - 2), F.array(before, here), F.slice(s, q + 2, F.size(s))))  # concat() makes a lazy list each time

    def step(s: Column, _: Column) -> Column:
        return _let(F.array_min(s), lambda m: F.when(m >= NONE << 40, s).otherwise(_let(F.array_position(s, m).cast("int"), lambda q: merged(s, m, q))))

    each = F.transform(parts, lambda x, i: high(rank(x, F.get(parts, i + 1))).bitwiseOR(F.shiftleft(i.cast("bigint"), 16)).bitwiseOR(x.cast("bigint")))
    last = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), F.concat(F.array(front), each), step)
    return F.transform(F.slice(last, 2, F.size(parts)), id_of)


def pieces(text: Column, pattern: str) -> Column:
    """Every match of the pattern; (?U) gives \\s its Unicode meaning in the JVM."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _cuts(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with ``most`` values or one row each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1))
        yield at, to
        at = to


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word, in time n log n: the leftmost pair of least rank merges first."""
    piece: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if piece[i] is None or j == len(word) or ranks.get(piece[i] + piece[j]) != r:
            continue  # one of the two has merged since
        piece[i], piece[j], after[i] = piece[i] + piece[j], None, after[j]
        if after[i] < len(word):
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < len(word) and (new := ranks.get(piece[x] + piece[y])) is not None:
                heapq.heappush(heap, (new, x))
    return [ranks[x] for x in piece if x is not None]


class SurePairs:
    """Pairs of bytes that merge whatever stands around them, so that a fold may start behind these merges.

    A pair ab between x and y is sure if its rank is below that of every token that ends in xa or
    begins with by, so that none can take a or b away while ab is there to merge; and if no longer
    token that begins or ends with ab has a lower rank, which would make it merge on too early.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.rank, self.left, self.right = (np.full((256, 256), NONE, np.int32) for _ in range(3))
        for t, r in ranks.items():
            if len(t) > 1:
                self.right[t[0], t[1]] = min(self.right[t[0], t[1]], r)
                self.left[t[-2], t[-1]] = min(self.left[t[-2], t[-1]], r)
        for t, r in ranks.items():
            if len(t) == 2 and r <= min(self.right[t[0], t[1]], self.left[t[0], t[1]]):
                self.rank[t[0], t[1]] = r

    def begin(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of words that begin at ``first`` and follow each other: whether a sure pair begins at a byte; none overlap."""
        n = len(data)
        edge = np.zeros(n + 2, bool)
        edge[first] = edge[n:] = True
        byte = np.pad(data, (1, 2))  # those outside a word don't count
        x, a, b, y = byte[:n], byte[1 : n + 1], byte[2 : n + 2], byte[3 : n + 3]
        r = self.rank[a, b]
        return (r < NONE) & ~edge[1 : n + 1] & (edge[:n] | (r < self.left[x, a])) & (edge[2 : n + 2] | (r < self.right[b, y]))


class _Numbers:
    """Numbers of words by two 64-bit hashes, in a sorted array: 20 bytes a word."""

    def __init__(self):
        self.key = np.zeros(0, np.dtype([("a", "<u8"), ("b", "<u8")]))
        self.number = np.zeros(0, np.uint32)

    def known(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is known, number where it is)."""
        at = np.searchsorted(self.key["a"], key["a"])
        at[at == len(self.key)] = 0
        if not len(self.key):
            return np.zeros(len(key), bool), np.zeros(len(key), np.uint32)
        same = self.key[at] == key
        for i in np.flatnonzero(~same & (self.key["a"][at] == key["a"])).tolist():  # two words with the same first hash
            while at[i] + 1 < len(self.key) and self.key["a"][at[i] + 1] == key["a"][i] and not same[i]:
                at[i] += 1
                same[i] = self.key[at[i]] == key[i]
        return same, self.number[at]

    def add(self, key: np.ndarray) -> np.ndarray:
        """Numbers new keys, all distinct, in their order."""
        number = np.arange(len(self.key), len(self.key) + len(key), dtype=np.uint32)
        order = np.argsort(key["a"], kind="stable")
        at = np.searchsorted(self.key["a"], key["a"][order])
        self.key, self.number = np.insert(self.key, at, key[order]), np.insert(self.number, at, number[order])
        return number


class _Speller:
    """Numbers the words of a task; a word's number comes with its byte ids the first time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, schema: pa.Schema, held: int):
        self.byte_ids, self.ranks, self.pattern, self.schema, self.held = np.array([ranks[bytes([i])] for i in range(256)], np.int32), ranks, pattern, schema, held
        self.numbers, self.sure = _Numbers(), SurePairs(ranks)

    def spelt(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, anew: bool) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(starts), ROW_WORDS):
            s, e = starts[k : k + ROW_WORDS], ends[k : k + ROW_WORDS]
            if (e - s).max() > LONG_BYTES:
                spans = [data[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                ids = [self.byte_ids[x] if len(x) <= LONG_BYTES else np.array(merge_heap(x.tobytes(), self.ranks), np.int32) for x in spans]
                size, flat = np.array([len(x) for x in ids]), np.concatenate(ids)
            else:
                size = e - s
                first = np.cumsum(size) - size
                text = data[np.arange(int(size.sum())) + np.repeat(s - first, size)]
                begin = self.sure.begin(text, first)
                at = np.flatnonzero(begin)
                flat = self.byte_ids[text]
                flat[at] = self.sure.rank[text[at], text[at + 1]]
                flat, size = np.delete(flat, at + 1), size - np.add.reduceat(begin, first, dtype=np.int64)
            parts = _lists(np.concatenate([[0], np.cumsum(size)]), pa.array(flat))
            row = {"_codes": pa.nulls(1, pa.binary()), "_anew": pa.array([anew and k == 0]), "_parts": _lists(np.array([0, len(s)]), parts)}
            yield pa.RecordBatch.from_arrays([row[f.name] if f.name in row else pa.nulls(1, f.type) for f in self.schema], schema=self.schema)

    def batch(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists, odd = part.column(part.num_columns - 2), part.column(part.num_columns - 1)
        if odd.null_count < len(odd):  # texts with characters that are newer than the JVM's tables
            import regex

            found = [x if t is None else [m.group() for m in regex.finditer(self.pattern, t)] for x, t in zip(lists.to_pylist(), odd.to_pylist(), strict=True)]
            lists = pa.array(found, pa.list_(pa.string()))
        off = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        data, cuts = W.raw(coded.dictionary)
        starts, ends = cuts[:-1], cuts[1:]  # a match of the pattern is never empty
        key = np.empty(len(starts), self.numbers.key.dtype)
        key["a"], key["b"] = W.hash_spans(data, starts, ends), W.hash_spans(data, starts, ends, W.BYTE_AGAIN)
        if anew := len(self.numbers.key) + len(key) > self.held and len(self.numbers.key) > 0 and len(key) > 0:
            self.numbers = _Numbers()
        is_known, number = self.numbers.known(key)
        fresh = np.flatnonzero(~is_known)
        number[fresh] = self.numbers.add(key[fresh])
        yield from self.spelt(data, starts[fresh], ends[fresh], anew)
        codes = number[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(key) else number
        blob = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(((off - off[0]) * 4).astype(np.int32)), pa.py_buffer(codes)])
        yield pa.RecordBatch.from_arrays([*part.columns[:-2], blob, pa.nulls(part.num_rows, pa.bool_()), pa.nulls(part.num_rows, self.schema.field("_parts").type)], schema=self.schema)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, or a copy with room for ``n``; the system maps its new pages when they are written."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class _Placer:
    """Takes the folded ids of words in the order of their numbers and puts them into the texts."""

    def __init__(self):
        self.flat, self.begin, self.n, self.m = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), 0, 0

    def learn(self, folded: pa.ListArray) -> None:
        """Keeps the ids of more words, in buffers that double."""
        words = folded.flatten()
        size = np.diff(np.asarray(words.offsets, dtype=np.int64))
        more = words.flatten().to_numpy(zero_copy_only=False)
        self.flat, self.begin = _room(self.flat, self.n + len(more)), _room(self.begin, self.m + len(size) + 1)
        self.flat[self.n : self.n + len(more)] = more
        self.begin[self.m + 1 : self.m + 1 + len(size)] = self.n + np.cumsum(size)
        self.n, self.m = self.n + len(more), self.m + len(size)

    def ids(self, codes: pa.BinaryArray) -> pa.ListArray:
        off = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1].astype(np.int64)
        blob = codes.buffers()[2]
        code = np.frombuffer(blob, np.uint8)[off[0] : off[-1]].copy().view(np.uint32).astype(np.int64) if blob and off[-1] > off[0] else np.zeros(0, np.int64)
        size = self.begin[code + 1] - self.begin[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = self.flat[np.arange(int(ends[-1])) + np.repeat(self.begin[code] - ends[:-1], size)]
        return _lists(ends[(off - off[0]) // 4], pa.array(out, pa.int32()))


class _Texts:
    """Joins the ids of a text's rows, which follow each other; the first has number 0."""

    def __init__(self, names: list[str]):
        self.names, self.row, self.held = names, None, []

    def add(self, columns: list[pa.Array], number: np.ndarray, ids: pa.ListArray) -> Iterator[pa.RecordBatch]:
        heads, off = np.flatnonzero(number == 0), np.asarray(ids.offsets, dtype=np.int64)
        flat = ids.values.to_numpy(zero_copy_only=False)
        if not len(heads):
            self.held.append(flat)
            return
        if self.row is not None:
            self.held.append(flat[: off[heads[0]]])
            yield from self.end()
        last = int(heads[-1])
        if len(heads) > 1:
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(heads[:-1])) for c in columns), _lists(off[heads] - off[heads[0]], pa.array(flat[off[heads[0]] : off[last]]))], self.names)
        self.row, self.held = [c.slice(last, 1) for c in columns], [flat[off[last] :]]

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.row is not None:
            flat = np.concatenate(self.held)
            yield pa.RecordBatch.from_arrays([*self.row, _lists(np.array([0, len(flat)]), pa.array(flat, pa.int32()))], self.names)
            self.row, self.held = None, []


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", held: int = HELD_WORDS, row_pieces: int = ROW_PIECES) -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of the text column.

    Each match of ``pattern`` is encoded by itself and special tokens are ordinary text.  A task
    folds each of its distinct words once, or once more for every ``held`` others; scans in smaller
    splits are read in tasks of ``TASK_BYTES``, as long as every core has one.  Words of
    more than ``LONG_BYTES`` bytes are merged by a heap, with the same ids.  Rows on the way to the
    workers hold ``row_pieces`` matches each; fewer make smaller batches, in the JVM and in the workers.

    Null or empty texts have no ids.  Rows are independent: repeated ids or rows and other columns,
    which are kept (but for one named ids), make no difference, and an empty table gives an empty
    result.
    """
    ranks = load_ranks(path)
    size = int(str(docs.select(text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the scan
    docs = docs.coalesce(min(2**30, max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    odd = (F.octet_length(text) > F.length(text)) & text.rlike(r"\p{Cn}")
    rest = [c for c in docs.columns if c not in (text_col, "ids")]
    plain = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)]
    split = docs.select(*plain, F.when(~odd, pieces(text, pattern)).otherwise(F.array().cast("array<string>")).alias("_pieces"), F.when(odd, text).alias("_odd"))
    some = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_pieces") - 1, F.lit(0)), F.lit(row_pieces)), lambda i: F.slice("_pieces", i + 1, row_pieces))
    rows = split.select(*[f"_c{i}" for i in range(len(rest))], "_odd", F.posexplode(some).alias("_at", "_part")).select(*[f"_c{i}" for i in range(len(rest))], "_at", "_part", "_odd")
    empty = "array<array<int>>"
    kept = docs.select(*plain)
    between = kept.select("*", F.lit(None).cast("int").alias("_at"), F.lit(None).cast("binary").alias("_codes"), F.lit(None).cast("boolean").alias("_anew"), F.lit(None).cast(empty).alias("_parts")).schema
    final = kept.select("*", F.lit(None).cast("array<int>").alias("ids")).schema
    for f in between.fields:  # rows of words have nothing in the other columns
        f.nullable = True

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = None
        for batch in W.rests(batches, lambda b: len(b.column(b.num_columns - 2).flatten()), REST_PIECES):
            if speller is None:
                fields = [pa.field(f.name, f.type) for f in list(batch.schema)[:-2]]
                more = [pa.field("_codes", pa.binary()), pa.field("_anew", pa.bool_()), pa.field("_parts", pa.list_(pa.list_(pa.int32())))]
                speller = _Speller(ranks, pattern, pa.schema([*fields, *more]), held)
            for at, to in _cuts(np.asarray(batch.column(batch.num_columns - 2).offsets, dtype=np.int64), SLICE_PIECES):
                yield from speller.batch(batch.slice(at, to - at))
            del batch

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placer, texts = _Placer(), _Texts([f.name for f in final])
        for batch in W.rests(batches, lambda b: b.num_rows * row_pieces, REST_PIECES):
            codes, anew, folded = (batch.column(batch.num_columns - k) for k in (3, 2, 1))
            is_words = np.asarray(folded.is_valid())
            edges = [0, *(np.flatnonzero(np.diff(is_words) | (np.asarray(anew.fill_null(False))[1:])) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if is_words[s]:
                    if anew[s].as_py():
                        placer = _Placer()
                    placer.learn(folded.slice(s, e - s))
                    continue
                run = batch.slice(s, e - s)
                off = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset + s : codes.offset + e + 1].astype(np.int64)
                for at, to in _cuts(off, 4 * SLICE_PIECES):
                    part = run.slice(at, to - at)
                    yield from texts.add(part.columns[:-4], part.column(part.num_columns - 4).to_numpy(), placer.ids(part.column(part.num_columns - 3)))
            run = part = None
            del batch, codes, anew, folded
        yield from texts.end()

    table = PairTable(ranks)
    folded = table.bound(lambda rank: F.transform("_parts", lambda x: F.when(F.size(x) > LONG_BYTES, x).otherwise(merge_fold(x, rank)))).alias("_folded")
    out = rows.mapInArrow(W.tidy(spell), between).select(*[f"_c{i}" for i in range(len(rest))], "_at", "_codes", "_anew", folded).mapInArrow(W.tidy(place), final)
    del table
    W.give_back()  # of the driver
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(rest)], "ids")


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded`` (binary): the tokens' byte pieces, joined.

    The pieces are a literal array of hex strings, so no Python runs here.  Null or no ids decode to
    no bytes; an unknown id is an error.
    """
    pieces_of = sorted((i, b.hex()) for b, i in load_ranks(path).items())
    if [i for i, _ in pieces_of] != list(range(len(pieces_of))):
        raise ValueError("decode: ids must run from 0 without a gap")
    literal = F.from_json(F.lit("[" + ",".join(f'"{x}"' for _, x in pieces_of) + "]"), "array<string>")
    joined = F.array_join(F.transform(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda i: F.element_at(literal, i + 1)), "")
    return tokens.withColumn("decoded", F.unhex(joined))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    path = tokenizers.path(RANKS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokens = encode(docs, path, tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    digest = decode(tokens, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return digest
