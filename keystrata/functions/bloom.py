"""Bloom filters: sizes, probe positions, packed filters, containers and tests.

Filters are built and tested in Arrow batches of rows sorted by box, so that a task holds one box's filter (or one
barrel's filters) and a batch, and no filter is copied to a row of a probe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.config import BLOOM_BITS_PER_KEY, BLOOM_PROBES

LOW = 2**32 - 1


def filter_bits(n: Column) -> Column:
    """Usable bits for n keys: 16 a key, 8 bytes at least, less the last three."""
    return (F.greatest(F.lit(8), F.ceil(n * BLOOM_BITS_PER_KEY / F.lit(8))) * 8 - 3).cast("bigint")


def positions(hv: Column, bits: Column) -> Column:
    """Eleven probe positions: hv + j * rotr(hv, 31) modulo 2**64, modulo bits (below 2**31).

    Hash and rotation are kept in 32-bit halves, so that all steps are plain integers.
    """
    low = hv.bitwiseAND(LOW)
    high = F.shiftrightunsigned(hv, 32)

    def at(h: Column, j: Column) -> Column:
        turned = h.high * 2 + F.shiftright(h.low, 31)
        sum_low = h.low + j * turned.bitwiseAND(LOW)
        sum_high = (h.high + j * (h.low.bitwiseAND(2**31 - 1) * 2 + F.shiftright(turned, 32)) + F.shiftright(sum_low, 32)).bitwiseAND(LOW)
        return ((sum_high % bits) * (F.lit(2**32) % bits) + sum_low.bitwiseAND(LOW)) % bits

    halves = F.array(F.struct(high.alias("high"), low.alias("low")))
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(BLOOM_PROBES - 1).cast("bigint"))
    return F.get(F.transform(halves, lambda h: F.transform(steps, lambda j: at(h, j))), 0)


def _steps(hv: np.ndarray, bits: int) -> Iterator[Callable[[np.ndarray | slice], np.ndarray]]:
    """positions() over an array of unsigned hashes: for each step, a function that gives the positions of chosen rows."""
    turned = hv >> np.uint64(31) | hv << np.uint64(33)
    for j in range(BLOOM_PROBES):
        yield lambda at, j=np.uint64(j): ((hv[at] + j * turned[at]) % np.uint64(bits)).astype(np.int64)


def _match(hv: np.ndarray, bits: int, words: np.ndarray) -> np.ndarray:
    """Rows whose positions are all set; a row is left at its first bit that isn't."""
    at = np.arange(len(hv))
    for step in _steps(hv, bits):
        p = step(at)
        at = at[(words[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]
        if not len(at):
            break
    return at


def _numbers(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).view(kind)


def _cuts(columns: list[np.ndarray]) -> list[tuple[int, int]]:
    """(start, end) of each run of rows that are equal in all columns."""
    n = len(columns[0])
    new = np.zeros(max(0, n - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    starts = [0, *(np.flatnonzero(new) + 1).tolist()] if n else []
    return list(zip(starts, [*starts[1:], n], strict=False))


def build(keys: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, bits, words): one packed filter per box, from rows of (by, hv); bit p is bit p mod 64 of word p div 64.

    Boxes are barrels, or segments and barrels, by whole numbers.  A box's keys pass in sorted batches, so a box with
    very many keys costs its words, not its keys.
    """
    by = by or ["barrel"]
    sized = keys.select(*[F.col(c).cast("bigint").alias(c) for c in by], "hv").dropna()
    sized = sized.withColumn("bits", filter_bits(F.count("*").over(Window.partitionBy(*by)))).sortWithinPartitions(*by)
    schema = pa.schema([*[(c, pa.int64()) for c in by], ("bits", pa.int64()), ("words", pa.list_(pa.int64()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, words = None, None
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(by, box, strict=False), bits=box[-1], words=words.view(np.int64))], schema)
        for b in batches:
            cols, hashes = [_numbers(b.column(c)) for c in [*by, "bits"]], _numbers(b.column("hv"), np.uint64)
            for start, end in _cuts(cols):
                here = tuple(int(c[start]) for c in cols)
                if here != box:
                    if box is not None:
                        yield row()
                    box, words = here, np.zeros((here[-1] + 63) // 64, np.uint64)
                for step in _steps(hashes[start:end], box[-1]):
                    p = step(slice(None))
                    np.bitwise_or.at(words, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
        if box is not None:
            yield row()

    return sized.mapInArrow(pack, ", ".join(f"{c} bigint" for c in [*by, "bits"]) + ", words array<bigint>")


def set_bits(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(w))


def _meet(probes: DataFrame, boxes: DataFrame, told: str, tell: Callable[[list, np.ndarray], pa.Array]) -> DataFrame:
    """(id, told) of each probe (id, barrel, hv): what ``tell`` says of a barrel's boxes (as Python values) and a batch of its hashes.

    A barrel's boxes are sorted before its probes and are held while these pass; a barrel without boxes gets none.
    """
    kind = boxes.schema["boxes"].dataType.simpleString()
    key = F.col("barrel").cast("bigint").alias("barrel")
    rows = probes.select(key, F.lit(1).alias("turn"), "id", "hv", F.lit(None).cast(kind).alias("boxes"))
    rows = boxes.select(key, F.lit(0).alias("turn"), F.lit(None).cast(probes.schema["id"].dataType).alias("id"), F.lit(None).cast("bigint").alias("hv"), "boxes").union(rows)
    name, result = told.split()

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        barrel, held = None, []
        for b in batches:
            barrels, turns, hashes = _numbers(b.column("barrel")), _numbers(b.column("turn"), np.int32), _numbers(b.column("hv"), np.uint64)
            for start, end in _cuts([barrels, turns]):
                if turns[start] == 0:
                    barrel, held = barrels[start], held_boxes(b.column("boxes")[start])
                    continue
                known = held if b.column("barrel")[start].is_valid and barrels[start] == barrel else []
                yield pa.RecordBatch.from_arrays([b.column("id").slice(start, end - start), tell(known, hashes[start:end])], names=["id", name])

    def held_boxes(cell: pa.ListScalar) -> list[tuple[int, int, np.ndarray]]:
        return [(x["segment"].as_py(), x["bits"].as_py(), x["words"].values.to_numpy().view(np.uint64)) for x in cell]

    id_type = probes.schema["id"].dataType.simpleString()
    return rows.repartition("barrel").sortWithinPartitions("barrel", "turn").mapInArrow(pass_by, f"id {id_type}, {name} {result}")


def probe(probes: DataFrame, filters: DataFrame) -> DataFrame:
    """(id, match) of (id, barrel, hv); a barrel without a filter matches nothing."""

    def tell(held: list, hv: np.ndarray) -> pa.Array:
        out = np.zeros(len(hv), bool)
        for _, bits, words in held:
            out[_match(hv, bits, words)] = True
        return pa.array(out)

    one = F.array(F.struct(F.lit(0).cast("bigint").alias("segment"), "bits", "words"))
    return _meet(probes, filters.select("barrel", one.alias("boxes")), "match boolean", tell)


def container(filters: DataFrame, newer: DataFrame | None = None) -> DataFrame:
    """(barrel, boxes): the filters (segment, barrel, bits, words) of a barrel's segments, newest first.

    ``newer`` is put before what a container already holds.
    """
    box = F.struct("segment", "bits", "words")
    every = filters if newer is None else filters.unionByName(newer)
    return every.groupBy("barrel").agg(F.reverse(F.array_sort(F.collect_list(box))).alias("boxes"))


def merge_container(held: DataFrame, newer: DataFrame) -> DataFrame:
    """A container with the filters of newer segments in front of each barrel's boxes."""
    added = container(newer).withColumnRenamed("boxes", "front")
    both = held.join(added, "barrel", "full")
    none = F.array().cast(held.schema["boxes"].dataType)
    return both.select("barrel", F.concat(F.coalesce("front", none), F.coalesce("boxes", none)).alias("boxes"))


def match_segments(probes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(id, segments) of (id, barrel, hv): the segments whose filters match, newest first; others need not be read."""

    def tell(held: list, hv: np.ndarray) -> pa.Array:
        hits = [_match(hv, bits, words) for _, bits, words in held]
        rows = np.concatenate([np.zeros(0, np.int64), *hits])
        names = np.repeat(np.array([s for s, _, _ in held], np.int64), [len(x) for x in hits])
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(hv)))]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, names[np.argsort(rows, kind="stable")])

    return _meet(probes, boxes, "segments array<bigint>", tell)
