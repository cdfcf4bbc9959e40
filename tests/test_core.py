"""Every query against its SQL, and the store's invariants."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from keystrata.config import Config
from keystrata.functions import bloom, generators, routing
from keystrata.plans.queries import QUERIES, SQL
from keystrata.sources.store import Store
from keystrata.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def text(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "null" if v != v else f"{v:.12g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(text(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_bitmap_words_cover_every_segment(spark, tmp_path):
    e = spark.range(0, 200_000, 250).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit(1.0).alias("value"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, 62 * r.word + i) for r in QUERIES["q19_segment_bitmap"](spark, str(tmp_path)).collect() for i in range(62) if r.bitmap >> i & 1}
    assert got == {(i % 7, i // 1000) for i in range(0, 200_000, 250)}


def test_compaction_takes_every_segment(spark, tmp_path):
    e = spark.range(0, 20_000).select(F.col("id").alias("event_id"), (F.col("id") / 100).cast("long").alias("user_id"), F.col("id").cast("double").alias("value"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.user_id, r.event_id) for r in QUERIES["q13_compaction_output"](spark, str(tmp_path)).collect())
    assert got == [(u, 100 * u + 99) for u in range(200)]


def test_whole_tables_reach_the_operators(spark, duck):
    n = {t: duck.execute(f"select count(*) from {t}").fetchone()[0] for t in ("customer", "orders")}
    got = {q: QUERIES[q](spark, SF).count() for q in ("q02_multi_get", "q03_multi_get_hits", "q04_multi_get_misses", "q16_bloom_positions", "q28_fnv_scramble")}
    assert got["q02_multi_get"] == got["q03_multi_get_hits"] + got["q04_multi_get_misses"] == n["customer"]
    assert got["q16_bloom_positions"] == 11 * n["orders"] and got["q28_fnv_scramble"] == n["orders"]


def test_routing_matches_hashlib(spark):
    keys = [f"k{i}" for i in range(300)]
    h = routing.digest(F.col("key"))
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", routing.leaf_path(h).alias("p"), routing.barrel(h).alias("b"), routing.move_order(h, routing.barrel(h)).alias("m"), routing.chain(h).alias("c")).collect()
    for r in rows:
        d = hashlib.sha1(r.key.encode()).digest()
        le = lambda a, b: int.from_bytes(d[a : b + 1], "little")  # noqa: B023, E731
        w, s = le(12, 15), le(4, 11) % 8191 % 32
        assert (r.p, r.b, r.c) == (le(0, 1) & 4095, le(4, 11) % 8191, le(16, 19) % 64)
        assert r.m == ((w << s) & 0xFFFFFFFF | w >> (32 - s))


def test_fnv(spark):
    def fnv(x):
        h = 14695981039346656037
        for b in x.to_bytes(8, "little"):
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    got = spark.range(50).select((F.col("id") * 987654321).alias("x")).select("x", generators.fnv1a(F.col("x")).alias("h")).collect()
    assert all(int(r.h) == fnv(r.x) for r in got)


def test_generator_by_name():
    assert generators.by_name("x") is generators.scrambled_zipfian
    assert generators.by_name("nothing") is generators.uniform
    with pytest.raises(ValueError):
        generators.by_name("")


def rows_of(spark, start, n, tag):
    return spark.range(start, start + n).select(F.concat(F.lit("k"), F.col("id") % 40).alias("key"), F.concat(F.lit(tag), F.col("id")).alias("value"), F.col("id").alias("seq"))


def test_store_round_trip(spark, tmp_path):
    s = Store.open(spark, f"{tmp_path}/db", Config(feed_bytes=1, most_segments=7))
    for i in range(3):
        s.put(rows_of(spark, i * 30, 30, f"v{i}-"))
    before = sorted((bytes(r.key), bytes(r.value)) for r in s.latest().collect())
    assert s.get(b"k7") == b"v2-87" and s.get(b"none") is None
    assert s.compact() and s.compact()
    again = Store.open(spark, f"{tmp_path}/db")
    assert again.config == s.config
    assert sorted((bytes(r.key), bytes(r.value)) for r in again.latest().collect()) == before
    assert again.get(b"k7") == b"v2-87" and s.vacuum() >= 2
    assert sorted((bytes(r.key), bytes(r.value)) for r in again.latest().collect()) == before
    probes = spark.createDataFrame([(bytearray(b"k7"),), (bytearray(b"zz"),)], "key binary")
    assert sorted(r.found for r in again.multi_get(probes).collect()) == [False, True]


def test_store_rejects(spark, tmp_path):
    s = Store.open(spark, f"{tmp_path}/db")
    for key, value in ((b"", b"x"), (b"k", b"x" * 5000)):
        with pytest.raises(Exception, match="larger than a block"):
            s.put(spark.createDataFrame([(bytearray(key), bytearray(value))], "key binary, value binary"))
    s.put(spark.createDataFrame([(bytearray(b"k"), bytearray(b""))], "key binary, value binary"))
    assert s.get(b"k") == b"" and s.get(b"j") is None
    (tmp_path / "bad" / "segments").mkdir(parents=True)
    with pytest.raises(ValueError):
        Store.open(spark, f"{tmp_path}/bad")


def test_stream_into_store(spark, tmp_path):
    for i in range(3):
        rows_of(spark, i * 30, 30, f"v{i}-").write.mode("append").parquet(f"{tmp_path}/in")
    s = Store.open(spark, f"{tmp_path}/db", Config(feed_bytes=1))
    stream = spark.readStream.schema("key string, value string, seq bigint").option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in")
    ingest.into_store(stream, s, f"{tmp_path}/cp", compact_every=2).awaitTermination()
    assert s.get(b"k7") == b"v2-87" and s.latest().count() == 40
    n = len(s.manifest()["segments"])
    ingest.into_store(stream, s, f"{tmp_path}/cp", compact_every=2).awaitTermination()
    assert len(s.manifest()["segments"]) == n  # nothing is new
    ingest.into_store(stream, s, f"{tmp_path}/cp2").awaitTermination()  # another stream begins at batch 0 too
    assert len(s.manifest()["segments"]) > n and len(s.manifest()["streams"]) == 2
    assert s.put(rows_of(spark, 0, 1, "x"), batch_id=0, stream="one") > 0 and s.put(rows_of(spark, 0, 1, "x"), batch_id=0, stream="one") == -1


def pairs(spark, *rows):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "key string, value string, at int")


def test_put_order(spark, tmp_path):
    """A put without sequence is newer than all before; of a key that comes twice the last in order counts."""
    s = Store.open(spark, f"{tmp_path}/db")
    s.put(pairs(spark, ("k", "old")).select("key", "value", F.lit(100).alias("seq")))
    s.put(pairs(spark, ("k", "new")).select("key", "value"))
    assert s.get(b"k") == b"new"
    s.put(pairs(spark, ("k", "z"), ("k", "b"), ("j", "c"), ("k", "a")), order="at")
    assert s.get(b"k") == b"a" and s.get(b"j") == b"c"
    with pytest.raises(Exception, match="comes twice"):
        s.put(pairs(spark, ("k", "x"), ("k", "y")).select("key", "value"))
    assert s.get(b"k") == b"a"


def test_stop_inside_publish(spark, tmp_path):
    """A manifest that did not get its name is not there; two writers cannot publish one version."""
    s = Store.open(spark, f"{tmp_path}/db")
    s.put(pairs(spark, ("k", "v")).select("key", "value"))
    (tmp_path / "db/manifest/.next-2").write_text("{half")
    again = Store.open(spark, f"{tmp_path}/db")
    assert again.get(b"k") == b"v"
    m = again.manifest()
    again.put(pairs(spark, ("k", "w")).select("key", "value"))
    with pytest.raises(RuntimeError):
        s._publish({**m, "version": m["version"] + 1})
    assert s.get(b"k") == b"w"


def test_multi_get_reads_probed_paths_only(spark, tmp_path):
    s = Store.open(spark, f"{tmp_path}/db")
    s.put(rows_of(spark, 0, 40, "v"))
    s.compact(full=True)
    path = f"{int.from_bytes(hashlib.sha1(b'k7').digest()[:2], 'little') & 7}"
    got = s.multi_get(spark.createDataFrame([(bytearray(b"k7"),)], "key binary"))
    assert got.first().value == b"v7" and {f.split("slot=")[1][0] for f in got.inputFiles() if "slot=" in f} == {path}
    assert len(s.manifest()["segments"]) > 1


def test_recursive_compaction(spark, tmp_path):
    """Keys of one leaf go down all levels; no value changes."""
    keys = [k for k in (f"k{i}" for i in range(20_000)) if int.from_bytes(hashlib.sha1(k.encode()).digest()[:2], "little") & 4095 == 0o1234]
    s = Store.open(spark, f"{tmp_path}/db", Config(feed_bytes=10**9, most_segments=1))
    for i in range(2):
        s.put(pairs(spark, *[(k, f"{i}-{k}") for k in keys]).select("key", "value"))
    assert s.compact_down() == 4 and {(x["level"], x["path"]) for x in s.manifest()["segments"]} == {(4, "4321")}
    assert s.latest().count() == len(keys) and s.get(keys[0].encode()) == f"1-{keys[0]}".encode() and s.vacuum() > 0


def test_codecs(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**62]
    n = F.col("n")
    rows = spark.createDataFrame([(x,) for x in numbers], "n long").select("n", routing.varint(n).alias("v"), routing.varint_value(routing.varint(n)).alias("b"), routing.little_endian(n).alias("le"), routing.hex_text(n).alias("t")).collect()

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    assert all((bytes(r.v), r.b, bytes(r.le), r.t) == (varint(r.n), r.n, r.n.to_bytes(8, "little"), f"{r.n:016x}") for r in rows)
    broken = spark.createDataFrame([(bytearray(b"\xff" * 11),), (bytearray(b"\x80"),)], "v binary")
    assert [r[0] for r in broken.select(routing.varint_value(F.col("v"))).collect()] == [None, None]


def test_counter_by_name(spark):
    got = spark.range(0, 20, 1, 4).select(generators.by_name("counter", F.col("id"))(None, 10, 0).alias("c")).collect()
    assert sorted(r.c for r in got) == list(range(10, 30))


def test_distribution(spark):
    from keystrata.operators import metrics

    r = metrics.distribution(spark.range(1000).select((F.col("id") * 3).alias("v")), "v").where("pct = 50").first()
    assert (r.value, r["count"], r.least, r.largest) == (1500, 1000, 0, 2997)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def bit_positions(hv, bits):
    turned = (hv >> 31 | hv << 33) % 2**64
    return {(hv + j * turned) % 2**64 % bits for j in range(11)}


def test_filters_grow_with_their_keys(spark):
    """A large box, a small one and none at all; words aren't searched for, and no filter is joined to a probe's row."""
    h = routing.digest(F.col("id").cast("string"))
    keys = spark.range(0, 30_000, 1, 5).select("id", F.when(F.col("id") < 29_990, 0).when(F.col("id") < 29_999, 1).alias("barrel").cast("bigint"), routing.bloom_hash(h).alias("hv"))
    filters = bloom.build(keys.select("barrel", "hv"))
    got = {r.barrel: r for r in filters.collect()}
    assert sorted(got) == [0, 1] and [len(got[b].words) for b in (0, 1)] == [-(-29_990 * 16 // 64), 3]
    want = {0: set(), 1: set()}
    hashes = [int.from_bytes(hashlib.sha1(str(i).encode()).digest()[12:20], "little") for i in range(30_000)]
    for i in range(29_999):
        want[int(i >= 29_990)] |= bit_positions(hashes[i], got[int(i >= 29_990)].bits)
    for b in (0, 1):
        assert {64 * w + p for w, x in enumerate(got[b].words) for p in range(64) if x >> p & 1} == want[b]
    probes = spark.range(0, 30_000, 7).select("id", (F.col("id") % 4).alias("barrel"), routing.bloom_hash(h).alias("hv")).withColumn("barrel", F.when(F.col("barrel") < 3, F.col("barrel")))
    out = bloom.probe(probes, filters)
    assert {r.id: r.match for r in out.collect()} == {i: i % 4 < 2 and bit_positions(hashes[i], got[i % 4].bits) <= want[i % 4] for i in range(0, 30_000, 7)}
    assert "Join" not in plan_of(out) and "element_at" not in plan_of(filters)


def test_codecs_have_no_lambdas(spark):
    """Every length of a code, numbers above 2**63 as negative ones, and what follows a code; expressions with lambdas aren't compiled."""
    numbers = [None, *[x for i in range(1, 10) for x in (2 ** (7 * i) - 1, 2 ** (7 * i)) if x < 2**63], 2**63 - 1, -1, -(2**63)]
    n = F.col("n")
    df = spark.createDataFrame([(x,) for x in numbers], "n long").select("n", routing.varint(n).alias("v"), routing.little_endian(n).alias("le"))
    df = df.withColumn("b", routing.varint_value(F.concat("v", F.unhex(F.lit("85")))))
    for r in df.collect():
        x, out = r.n, b""
        if x is None:
            assert (r.v, r.b, r.le) == (None, None, None)
            continue
        u = x % 2**64
        while u > 127:
            out, u = out + bytes([u & 127 | 128]), u >> 7
        assert (bytes(r.v), r.b, bytes(r.le)) == (out + bytes([u]), x, x.to_bytes(8, "little", signed=True))
    assert "lambda" not in plan_of(df)
    none = spark.createDataFrame([(bytearray(b""),), (bytearray(b"\x80" * 10 + b"\x01"),)], "v binary")
    assert [r[0] for r in none.select(routing.varint_value(F.col("v"))).collect()] == [None, None]


def test_overflow_reports_pass_the_rows_once(spark):
    for q in ("q35_overflow_index", "q53_lookup_cost", "q54_uncovered_overflow", "q55_verbose_report", "q56_moved_histogram", "q58_index_by_id", "q59_index_search"):
        assert plan_of(QUERIES[q](spark, SF)).count("parquet") == 1, q


def test_probes_do_not_carry_filters(spark):
    """A filter that is joined to its probes is copied once a probe."""
    assert "Join" not in plan_of(QUERIES["q18_bloom_probe"](spark, SF))
    assert "Join" not in plan_of(QUERIES["q52_engine_report"](spark, SF))


def test_container_matches_each_segment(spark):
    """Segments newest first, none for a barrel without filters; the boxes of a barrel are not joined to its probes."""
    hv = (F.col("id") * 7919 + 2**62).alias("hv")
    keys = spark.range(0, 400).select((F.col("id") % 4).alias("segment"), (F.col("id") % 3).alias("barrel"), hv)
    filters = bloom.build(keys, ["segment", "barrel"])
    boxes = bloom.merge_container(bloom.container(filters.where("segment < 2")), filters.where("segment >= 2"))
    probes = spark.range(0, 800).select("id", F.when(F.col("id") % 5 < 4, F.col("id") % 5).alias("barrel"), hv)
    bits, held = {}, {}
    for i in range(400):
        held.setdefault((i % 4, i % 3), []).append(i * 7919 + 2**62)
    for box, hashes in held.items():
        n = max(8, 2 * len(hashes)) * 8 - 3
        bits[box] = n, set().union(*[bit_positions(x, n) for x in hashes])
    out = bloom.match_segments(probes, boxes)
    want = {i: [s for s in (3, 2, 1, 0) if i % 5 < 3 and bit_positions(i * 7919 + 2**62, bits[s, i % 5][0]) <= bits[s, i % 5][1]] for i in range(800)}
    assert {r.id: r.segments for r in out.collect()} == want and any(len(x) > 0 for x in want.values())
    assert "LeftOuter" not in plan_of(out)
