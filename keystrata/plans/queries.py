"""Registered queries of the engine, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.config import BLOCK_BYTES, COVER_PERCENT, INDEX_CAP, Config
from keystrata.functions import bloom, generators, routing
from keystrata.operators import merge, metrics
from keystrata.session import checkpoint_dir
from keystrata.sources.store import Store
from keystrata.streaming import ingest

SEGMENT_ROWS = 1000  # events of one synthetic segment
FEED_CAP = 40_000  # bytes; stands for the feed size of full segments
WORD_BITS = 62  # segments of one bitmap word


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(c: str) -> Column:
    return F.col(c).cast("string")


def _seg(c: str) -> Column:
    return F.floor(F.col(c) / SEGMENT_ROWS).cast("bigint")


def _le(first: int, last: int, h: str = "h") -> str:
    return "CAST(('0x' || " + " || ".join(f"substr({h}, {2 * i + 1}, 2)" for i in range(last, first - 1, -1)) + ") AS UBIGINT)"


LATEST_EVENTS = "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id"
PROBES = "SELECT c_custkey AS user_id FROM customer"
ORDER_HASH = "SELECT o_orderkey, sha1(CAST(o_orderkey AS VARCHAR)) AS h FROM orders"
BARREL = f"CAST(({_le(8, 11)}::HUGEINT * 64 + {_le(4, 7)}::HUGEINT) % 8191 AS BIGINT)"
PATH = f"CAST({_le(0, 1)} % 4096 AS BIGINT)"
EVENT_LOG = f"""SELECT event_id // 1000 AS seg, event_id, user_id, value,
  octet_length(encode(CAST(user_id AS VARCHAR))) + octet_length(encode(CAST(event_id AS VARCHAR))) + 2 AS volume FROM events"""


def _events(spark, d):
    return _read(spark, d, "events").select("user_id", "event_id", "value")


def latest_events(spark, d):
    return merge.latest(_events(spark, d), ["user_id"], "event_id").select("user_id", "event_id", "value")


def _probes(spark, d):
    return _read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))


def multi_get(spark, d):
    return merge.multi_get(_probes(spark, d), _events(spark, d), "user_id", "event_id").select("user_id", "found", "event_id", "value")


def multi_get_hits(spark, d):
    return merge.hits(_probes(spark, d), _events(spark, d), "user_id")


def multi_get_misses(spark, d):
    return merge.misses(_probes(spark, d), _events(spark, d), "user_id")


def _orders(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", routing.digest(_key("o_orderkey")).alias("h"))


def route(spark, d):
    h = F.col("h")
    return _orders(spark, d).select("o_orderkey", routing.leaf_path(h).alias("path"), *[routing.slot(h, i).alias(f"slot{i}") for i in range(4)], routing.barrel(h).alias("barrel"))


def chain_and_order(spark, d):
    h = F.col("h")
    return _orders(spark, d).select("o_orderkey", routing.chain(h).alias("chain"), routing.move_order(h, routing.barrel(h)).alias("move_order"))


def row_volume(spark, d):
    return _read(spark, d, "documents").select("doc_id", routing.volume(_key("doc_id"), F.col("text")).alias("volume"))


def oversize_rows(spark, d):
    return row_volume(spark, d).where(F.col("volume") > BLOCK_BYTES)


def _event_log(spark, d):
    e = _read(spark, d, "events").select("event_id", "user_id", "value")
    return e.select(_seg("event_id").alias("seg"), "event_id", "user_id", "value", routing.volume(_key("user_id"), _key("event_id")).alias("volume"))


def segment_fill(spark, d):
    return _event_log(spark, d).groupBy("seg").agg(F.count("*").alias("items"), F.sum("volume").alias("volume"))


def _placed(spark, d):
    """Segments dealt to eight nodes, oldest first."""
    o = _read(spark, d, "orders")
    return o.select(F.pmod("o_custkey", F.lit(8)).cast("int").alias("node"), F.floor(F.col("o_orderkey") / 500).cast("bigint").alias("pos"), routing.volume(_key("o_orderkey"), F.col("o_orderpriority")).alias("v")).groupBy("node", "pos").agg(F.sum("v").alias("volume"))


PLACED = """SELECT CAST(o_custkey % 8 AS INTEGER) AS node, o_orderkey // 500 AS pos,
  CAST(sum(octet_length(encode(CAST(o_orderkey AS VARCHAR))) + octet_length(encode(o_orderpriority)) + 2) AS BIGINT) AS volume FROM orders GROUP BY 1, 2"""
FEED = f"""SELECT node, CAST(coalesce(min(CASE WHEN run >= {FEED_CAP // 10} THEN nth END), 0) AS BIGINT) AS nr_feed FROM (
  SELECT node, sum(volume) OVER w AS run, row_number() OVER w AS nth FROM ({PLACED}) WINDOW w AS (PARTITION BY node ORDER BY pos)) GROUP BY node"""


def feed_prefix(spark, d):
    return merge.feed_prefix(_placed(spark, d), ["node"], "pos", "volume", FEED_CAP // 10)


def pick_fullest_child(spark, d):
    return feed_prefix(spark, d).orderBy(F.desc("nr_feed"), "node").limit(1)


def full_children(spark, d):
    return _placed(spark, d).groupBy("node").agg(F.count("*").alias("segments")).where("segments >= 20")


def _slot_of_user():
    return routing.slot(routing.digest(_key("user_id")), 0)


def _compacted(log: DataFrame) -> DataFrame:
    return merge.compact(log.select("user_id", "event_id", "value"), ["user_id"], "event_id", _slot_of_user()).select("user_id", "event_id", "value", "slot")


def compaction_output(spark, d):
    """A compaction of every segment."""
    return _compacted(_event_log(spark, d))


def compaction_invariant(spark, d):
    """Newest rows after the older half of all segments was compacted."""
    log = _event_log(spark, d)
    half = log.agg(F.max("seg").alias("last")).select(F.expr("last div 2").alias("half"))
    log = log.crossJoin(F.broadcast(half))  # one row
    rest = log.where("seg > half").select("user_id", "event_id", "value")
    return merge.latest(rest.unionByName(_compacted(log.where("seg <= half")).drop("slot")), ["user_id"], "event_id").select("user_id", "event_id", "value")


def version_amplification(spark, d):
    rows = _event_log(spark, d).groupBy("seg", "user_id").agg(F.count("*").alias("n"))
    return rows.groupBy("seg").agg(F.sum("n").alias("stored"), F.count("*").alias("keys")).withColumn("amplification", metrics.ratio(F.col("stored"), F.col("keys")))


def _bloom_keys(spark, d, barrels: int = 64):
    h = F.col("h")
    return _orders(spark, d).select(F.col("o_orderkey").alias("id"), (routing.barrel(h) % barrels).alias("barrel"), routing.bloom_hash(h).alias("hv"))


def bloom_positions(spark, d):
    at = bloom.positions(F.col("hv"), F.lit(1021).cast("bigint"))
    return _bloom_keys(spark, d).select(F.col("id").alias("o_orderkey"), F.posexplode(at).alias("j", "pos"))


BLOOM_KEYS = f"SELECT o_orderkey AS id, {BARREL} % 64 AS barrel, {_le(12, 19)}::HUGEINT AS hv FROM ({ORDER_HASH})"
POS = "CAST(((hv + j * ((hv % 2147483648) * 8589934592 + hv // 2147483648)) % 18446744073709551616) % bits AS BIGINT)"
FILTERS = f"""SELECT DISTINCT barrel, bits, {POS} AS pos FROM
  (SELECT k.barrel, hv, bits FROM ({BLOOM_KEYS}) k JOIN (SELECT barrel, CAST(greatest(8, 2 * count(*)) * 8 - 3 AS BIGINT) AS bits FROM ({BLOOM_KEYS}) WHERE id % 2 = 0 GROUP BY barrel) b ON k.barrel = b.barrel WHERE id % 2 = 0), range(0, 11) r(j)"""


def _filters(spark, d):
    return bloom.build(_bloom_keys(spark, d).where("id % 2 = 0").select("barrel", "hv"))


def bloom_filter_bits(spark, d):
    return _filters(spark, d).select("barrel", "bits", bloom.set_bits(F.col("words")).alias("set_bits"))


def bloom_probe(spark, d):
    keys = _bloom_keys(spark, d)
    got = bloom.probe(keys, _filters(spark, d))
    return got.groupBy((F.col("id") % 2 == 0).alias("present")).agg(F.count("*").alias("probes"), F.sum(F.col("match").cast("bigint")).alias("matches"))


def segment_bitmap(spark, d):
    """Bitmaps of all segments: one row per user and word of ``WORD_BITS`` segments."""
    word, bit = F.expr(f"seg div {WORD_BITS}"), F.expr(f"cast(seg % {WORD_BITS} as int)")
    held = _event_log(spark, d).select("user_id", "seg").distinct()
    return held.groupBy("user_id", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bitmap"))


def barrel_histogram(spark, d):
    per = _orders(spark, d).groupBy(routing.barrel(F.col("h")).alias("barrel")).agg(F.count("*").alias("items"))
    return per.groupBy("items").agg(F.count("*").alias("barrels"))


def segment_report(spark, d):
    return _event_log(spark, d).groupBy("seg").agg(F.sum("volume").alias("volume"), F.count("*").alias("items"), F.countDistinct("user_id").alias("keys")).withColumn("percent", metrics.ratio(F.col("volume"), F.lit(32 * 1024 * 1024), 100.0))


def trie_rollup(spark, d):
    h = F.col("h")
    rows = _orders(spark, d).select(*[routing.slot(h, i).alias(f"slot{i}") for i in range(3)])
    return rows.rollup("slot0", "slot1", "slot2").agg(F.count("*").alias("items"))


def hit_level(spark, d):
    o = _read(spark, d, "orders").select("o_custkey", "o_orderkey")
    newest = merge.latest(o, ["o_custkey"], "o_orderkey")
    return newest.groupBy((_seg("o_orderkey") % 5).alias("level")).agg(F.count("*").alias("hits"))


def amplification(spark, d):
    """Per level: rows written for a key that stays, and the share of customers that are not found there."""
    keys = _event_log(spark, d).groupBy((F.col("seg") % 3).alias("level"), "user_id").agg(F.count("*").alias("n"))
    probes = _probes(spark, d)
    c = keys.join(probes.withColumn("probed", F.lit(1)), "user_id", "left").groupBy("level").agg(F.sum("n").alias("written"), F.count("*").alias("kept"), F.count("probed").alias("hits"))
    c = c.crossJoin(F.broadcast(probes.agg(F.count("*").alias("probes"))))  # one row
    return c.select("level", "written", "kept", metrics.ratio(F.col("written"), F.col("kept")).alias("write_amp"), metrics.ratio(F.col("probes") - F.col("hits"), F.col("probes"), 100.0).alias("miss_ratio"))


def _usec(spark, d):
    return _read(spark, d, "events").select(F.floor("value").cast("bigint").alias("usec"))


def latency_histogram(spark, d):
    h = metrics.latency_histogram(_usec(spark, d))
    return h.withColumn("t", F.sum("count").over(Window.partitionBy())).where("count > shiftright(t, 10)").select("bucket", "count")


def latency_percentiles(spark, d):
    return metrics.latency_percentiles(_usec(spark, d), [950, 990, 999])


def qps_report(spark, d):
    return metrics.throughput(_read(spark, d, "events").select("event_id", "ts"), "event_id", "ts", SEGMENT_ROWS).select("batch", "ops", "delta_usec", "qps")


def fnv_scramble(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", (generators.fnv1a(F.col("o_orderkey")) % F.lit(2000).cast("decimal(20,0)")).cast("bigint").alias("scrambled"))


U_ID = "CAST(CAST('0x' || substr(sha1(CAST(event_id AS VARCHAR)), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0"


def zipf_draws(spark, d):
    u = generators.uniform_of(F.col("event_id"))
    return _read(spark, d, "events").select("event_id", generators.zipfian(u, 20, 2000).alias("draw"))


def _zipf_sql() -> str:
    n, zn, eta, alpha = generators.zipf_constants(20, 2000)
    return f"""SELECT event_id, CAST(CASE WHEN u * {zn!r}::DOUBLE < 1.0 THEN 20 WHEN u * {zn!r}::DOUBLE < {1.0 + 0.5**0.99!r}::DOUBLE THEN 21
      ELSE 20 + floor({float(n)!r}::DOUBLE * pow({eta!r}::DOUBLE * (u - 1.0) + 1.0, {alpha!r}::DOUBLE)) END AS BIGINT) AS draw FROM (SELECT event_id, {U_ID} AS u FROM events)"""


def generator_draws(spark, d):
    u = generators.uniform_of(F.col("event_id"))
    return _read(spark, d, "events").select("event_id", generators.constant(1984).alias("c"), generators.uniform(u, 20, 2000).alias("uni"), generators.exponential(u, 95.0, 100.0).alias("expo"))


def distribution_report(spark, d):
    return metrics.distribution(_usec(spark, d), "usec").select("pct", "value")


def heavy_hitters(spark, d):
    return metrics.heavy_hitters(zipf_draws(spark, d), "draw")


def unit_map(spark, d):
    units = _read(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_orderstatus") == "F").alias("used"))
    return metrics.unit_map(units)


def manifest_tree(spark, d):
    """The tree in preorder: every line with the key that orders it."""
    path = F.concat_ws("", *[(F.floor(F.col("seg") / 8**i) % 8).cast("bigint").cast("string") for i in range(4)])
    segs = _event_log(spark, d).select("seg").distinct().select("seg", (F.col("seg") % 4).cast("int").alias("level"), path.alias("p")).select("seg", F.substring("p", F.lit(1), F.col("level")).alias("path"))
    nodes = segs.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring("path", F.lit(1), i))).alias("path")).distinct()
    n3 = F.concat(F.lit("[ "), (F.length("path") * 3).cast("string"))
    parts = [("0", n3), ("1", F.lit("<")), ("3", F.lit(">"))]
    lines = [nodes.select(F.concat("path", F.lit(f" {k}")).alias("at"), line.alias("line")) for k, line in parts]
    close = nodes.select(F.concat("path", F.lit("~")).alias("at"), F.lit("]").alias("line"))
    ids = F.lpad(F.lower(F.hex(F.col("seg") + 1)), 16, "0")
    items = segs.select(F.concat("path", F.lit(" 2"), ids).alias("at"), ids.alias("line"))
    out = items.union(close)
    for x in lines:
        out = out.union(x)
    return out


MANIFEST = """WITH segs AS (SELECT seg, substr(CAST(seg % 8 AS VARCHAR) || CAST(seg // 8 % 8 AS VARCHAR) || CAST(seg // 64 % 8 AS VARCHAR) || CAST(seg // 512 % 8 AS VARCHAR), 1, CAST(seg % 4 AS INTEGER)) AS path
    FROM (SELECT DISTINCT event_id // 1000 AS seg FROM events)),
  nodes AS (SELECT DISTINCT substr(path, 1, CAST(i AS INTEGER)) AS path FROM segs, range(0, 5) r(i) WHERE i <= length(path))
SELECT path || ' 0' AS at, '[ ' || CAST(length(path) * 3 AS VARCHAR) AS line FROM nodes UNION ALL
SELECT path || ' 1', '<' FROM nodes UNION ALL SELECT path || ' 3', '>' FROM nodes UNION ALL SELECT path || '~', ']' FROM nodes UNION ALL
SELECT path || ' 2' || lpad(lower(hex(seg + 1)), 16, '0'), lpad(lower(hex(seg + 1)), 16, '0') FROM segs"""


def _moves(spark, d, cap: int = 64):
    """Rows of overloaded barrels in move order, with the volume that stands before each."""
    o = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", routing.digest(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("h"))
    b = o.select(F.unhex("h").alias("h"), (routing.barrel(F.col("h")) % 512).alias("barrel"), routing.move_order(F.col("h"), routing.barrel(F.col("h"))).alias("mo"), F.lit(24).cast("bigint").alias("volume"))
    w = Window.partitionBy("barrel").orderBy("mo", "h").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("upto", F.sum("volume").over(w)).withColumn("total", F.sum("volume").over(Window.partitionBy("barrel"))).withColumn("cap", F.lit(cap * 24))


def _barrel_moves(spark, d):
    """(barrel, items, nr_out, least_kept_above) of every barrel: its rows, and those that leave it, least in move order first.

    One pass over the rows; what else is told of overflow comes of this table of at most 8,191 rows.
    """
    out = F.expr("total > cap AND upto - volume < total - cap")
    return _moves(spark, d).groupBy("barrel").agg(F.count("*").alias("items"), F.count_if(out).alias("nr_out"), F.max(F.when(out, F.col("mo"))).alias("least_kept_above"))


def overflow_moves(spark, d):
    """Per overloaded barrel: the rows that leave it, least in move order first."""
    return _barrel_moves(spark, d).where("nr_out > 0").select("barrel", "nr_out", "least_kept_above")


LINE_ROWS = f"""SELECT barrel, mo, 24 AS volume, h FROM (SELECT h, b % 512 AS barrel, CASE WHEN s = 0 THEN w ELSE ((w << s) & 4294967295) | (w >> (32 - s)) END AS mo FROM
  (SELECT h, {BARREL} AS b, CAST({BARREL} % 32 AS INTEGER) AS s, CAST({_le(12, 15)} AS BIGINT) AS w FROM
  (SELECT sha1(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR)) AS h FROM lineitem)))"""
MOVES = f"""SELECT barrel, count(*) AS nr_out, max(mo) AS least_kept_above FROM (
  SELECT barrel, mo, volume, sum(volume) OVER (PARTITION BY barrel ORDER BY mo, h ROWS UNBOUNDED PRECEDING) AS upto, sum(volume) OVER (PARTITION BY barrel) AS total FROM ({LINE_ROWS}))
  WHERE total > 1536 AND upto - volume < total - 1536 GROUP BY barrel"""


def _indexed(spark, d):
    """(barrel, items, nr_out, covered) of every barrel; the index covers those with most overflow first."""
    order, every = Window.orderBy(F.desc("nr_out"), "barrel"), Window.partitionBy()  # at most 8,191 barrels
    ranked = _barrel_moves(spark, d).select("barrel", "items", "nr_out", F.sum("nr_out").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.row_number().over(order).alias("rk"), F.sum("items").over(every).alias("lookups"), F.sum("nr_out").over(every).alias("all_out"))
    todo = F.greatest(F.lit(0), F.expr(f"(lookups + all_out) * {COVER_PERCENT} div 100 - lookups"))
    covered = (F.col("nr_out") > 0) & ((F.col("run") - F.col("nr_out") < todo) | (F.col("rk") == 1)) & (F.col("rk") <= INDEX_CAP)
    return ranked.select("barrel", "items", "nr_out", covered.alias("covered"))


def overflow_index(spark, d):
    """Barrels by overflow, most first, until they cover the share of lookups that must be covered."""
    return _indexed(spark, d).where("covered").select("barrel", "nr_out")


INDEX = f"""SELECT barrel, nr_out FROM (SELECT barrel, nr_out, sum(nr_out) OVER (ORDER BY nr_out DESC, barrel ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (ORDER BY nr_out DESC, barrel) AS rk FROM ({MOVES})) m,
  (SELECT count(*) AS lookups FROM lineitem) a, (SELECT sum(nr_out) AS all_out FROM ({MOVES})) b
  WHERE (run - nr_out < greatest(0, (lookups + all_out) * {COVER_PERCENT} // 100 - lookups) OR rk = 1) AND rk <= {INDEX_CAP}"""


def mixed_batches(spark, d):
    """Of every 100 operations the first 60 write and the others read a key written before or not."""
    e = _read(spark, d, "events").select("event_id", "user_id")
    op = F.col("event_id") % 100
    first = e.where(op < 60).groupBy("user_id").agg(F.min("event_id").alias("first_write"))
    both = e.join(first, "user_id", "left").withColumn("write", op < 60)
    hit = ~F.col("write") & (F.col("first_write") < F.col("event_id"))
    return both.groupBy(_seg("event_id").alias("batch")).agg(F.sum(F.col("write").cast("bigint")).alias("writes"), F.sum((~F.col("write")).cast("bigint")).alias("reads"), F.sum(F.coalesce(hit, F.lit(False)).cast("bigint")).alias("hits"))


def staged_read(spark, d):
    """Four probe phases against a store of order keys: warm and uniform misses, hits, zipfian keys."""
    keys = _read(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    u = generators.uniform_of(F.col("event_id"))
    e = _read(spark, d, "events")
    n = 1_000_000_000
    phases = [("WARM", generators.uniform(u, n, 2 * n)), ("EUNI", generators.uniform(u, 1, 1500)), ("NUNI", generators.uniform(1.0 - u, n, 2 * n)), ("NZIP", generators.zipfian(u, 20, 2000))]
    probes = e.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), x.alias("k")) for p, x in phases])).alias("x")).select("x.*")
    return merge.multi_get(probes, keys.select("k", F.lit(0).alias("seq")), "k", "seq").groupBy("phase").agg(F.count("*").alias("probes"), F.sum(F.col("found").cast("bigint")).alias("hits"))


def _staged_sql() -> str:
    z = _zipf_sql()
    return f"""WITH u AS (SELECT event_id, {U_ID} AS u FROM events),
  p AS (SELECT 'WARM' AS phase, CAST(1000000000 + floor(u * 1000000000) AS BIGINT) AS k FROM u UNION ALL SELECT 'EUNI', CAST(1 + floor(u * 1499) AS BIGINT) FROM u
    UNION ALL SELECT 'NUNI', CAST(1000000000 + floor((1.0 - u) * 1000000000) AS BIGINT) FROM u UNION ALL SELECT 'NZIP', draw FROM ({z}))
SELECT phase, count(*) AS probes, CAST(sum(CASE WHEN o_orderkey IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM p LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders) o ON k = o_orderkey GROUP BY phase"""


def upsert_lineitem(spark, d):
    li = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_partkey", "l_suppkey")
    return merge.latest(li, ["l_orderkey", "l_linenumber"], F.struct("l_shipdate", "l_partkey", "l_suppkey")).select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")


def stream_latest(spark, d):
    return ingest.latest_once(spark, f"{d}/events.parquet", ["user_id"], "event_id", ["user_id", "event_id", "value"])


def point_lookup(spark, d):
    """One key, with the filter pushed below the aggregate."""
    return latest_events(spark, d).where("user_id = 7")


def _event_store(spark, d, puts: int = 3, **config) -> Store:
    """A store of its own, with the events put in turn."""
    s = Store.open(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}", Config(**config))
    e = _read(spark, d, "events").select(_key("user_id").alias("key"), _key("event_id").alias("value"), F.col("event_id").alias("seq"))
    for i in range(puts):
        s.put(e.where(F.pmod("seq", F.lit(puts)) == i), files=s._files(1))
    return s


def _stored(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").cast("bigint").alias("user_id"), F.col("value").cast("string").cast("bigint").alias("event_id"))


def store_round_trip(spark, d):
    """Every event put, two compactions, then the newest value of every key."""
    s = _event_store(spark, d)
    s.compact(full=True)
    s.compact(full=True)
    return _stored(s.latest())


def store_multi_get(spark, d):
    """Every customer looked up in a compacted store."""
    s = _event_store(spark, d)
    s.compact(full=True)
    probes = _probes(spark, d).select(_key("user_id").alias("key")).withColumn("key", F.col("key").cast("binary"))
    got = s.multi_get(probes)
    return got.select(F.col("key").cast("string").cast("bigint").alias("user_id"), "found", F.col("value").cast("string").cast("bigint").alias("event_id"))


def store_reopen(spark, d):
    """Segments of a store that was compacted, vacuumed and opened again without its configuration."""
    s = _event_store(spark, d, most_segments=3)
    s.compact_down()
    s.vacuum()
    return Store.open(spark, s.path).report().groupBy("level", "path").agg(F.sum("items").alias("items"), F.sum("volume").alias("volume"))


def engine_report(spark, d):
    """False positives among filter tests, useful share of fetches, fetches per hit."""
    got = bloom_probe(spark, d)
    one = lambda present, c: F.sum(F.when(F.col("present") == present, F.col(c)).otherwise(0))
    n = got.agg(one(True, "matches").alias("tp"), one(False, "matches").alias("fp"), (one(False, "probes") - one(False, "matches")).alias("tn"))
    fetched = F.col("tp") + F.col("fp")
    return n.select("tp", "fp", "tn", metrics.ratio(F.col("fp"), fetched + F.col("tn"), 100.0).alias("fp_percent"), metrics.ratio(F.col("tp"), fetched, 100.0).alias("fetch_efficiency"), metrics.ratio(fetched, F.col("tp")).alias("read_amp"))


def lookup_cost(spark, d):
    """Lookups of a barrel: one a row, and one more for each row that moved away."""
    return _barrel_moves(spark, d).select("barrel", (F.col("items") + F.col("nr_out")).alias("lookups"))


def uncovered_overflow(spark, d):
    """Moved rows that the index must cover so that the share of direct lookups is reached."""
    n = _barrel_moves(spark, d).agg(F.sum(F.col("items") + F.col("nr_out")).alias("lookups"), F.coalesce(F.sum("nr_out"), F.lit(0)).alias("moved"))
    return n.select("lookups", "moved", F.greatest(F.lit(0), F.expr(f"lookups * {COVER_PERCENT} div 100 - (lookups - moved)")).alias("todo"))


def verbose_report(spark, d):
    """Moved rows that the index covers and those it does not, and mean reads of a lookup."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    covered = F.when(F.col("covered"), F.col("nr_out"))
    n = _indexed(spark, d).agg(total("items").alias("items"), F.sum(F.col("items") + F.col("nr_out")).alias("lookups"), total(covered).alias("covered"), total("nr_out").alias("moved"))
    return n.select("items", "lookups", "covered", (F.col("moved") - F.col("covered")).alias("lost"), metrics.ratio(F.col("lookups") - F.col("covered"), F.col("items")).alias("avg_read"))


def moved_histogram(spark, d):
    return _barrel_moves(spark, d).groupBy("nr_out").agg(F.count("*").alias("barrels"))


def barrels_by_volume(spark, d):
    """Barrels with their place by volume, least first."""
    per = _moves(spark, d).groupBy("barrel").agg(F.sum("volume").alias("volume"))
    return per.withColumn("place", F.row_number().over(Window.orderBy("volume", "barrel")))  # at most 8,191 barrels


def index_by_id(spark, d):
    """The overflow index in the order of its ids, with each entry's place."""
    return overflow_index(spark, d).withColumn("place", F.row_number().over(Window.orderBy("barrel")))  # at most 2,048 entries


def index_search(spark, d):
    """Every barrel looked up in the overflow index."""
    return _indexed(spark, d).select("barrel", F.col("covered").alias("found"), F.when(F.col("covered"), F.col("nr_out")).alias("nr_out"))


def free_units(spark, d):
    """Used and free units of the unit map, and the used share."""
    n = _read(spark, d, "orders").agg(F.count("*").alias("units"), F.count_if(F.col("o_orderstatus") == "F").alias("used"))
    return n.select("units", "used", (F.col("units") - F.col("used")).alias("unused"), metrics.ratio(F.col("used"), F.col("units"), 100.0).alias("percent"))


def key_encodings(spark, d):
    """Keys as little-endian bytes, as text and as a varint, and the number the varint gives back."""
    k = F.col("o_orderkey")
    return _read(spark, d, "orders").select(k, F.hex(routing.little_endian(k)).alias("le"), routing.hex_text(k).alias("txt"), F.hex(routing.varint(k)).alias("varint"), routing.varint_value(routing.varint(k)).alias("back"))


def io_report(spark, d):
    e = _read(spark, d, "events").select("ts", routing.volume(_key("user_id"), _key("event_id")).alias("volume"))
    return metrics.io_report(e, "volume", "ts")


LEVEL_COUNT = 63


def container_probe(spark, d):
    """False positives of 63 segments' filters: customers looked up in a container built by merging."""
    h = routing.digest(_key("user_id"))
    e = _read(spark, d, "events").select(F.pmod(_seg("event_id"), F.lit(LEVEL_COUNT)).alias("segment"), "user_id").distinct()
    keys = e.select("segment", (routing.barrel(h) % 64).alias("barrel"), routing.bloom_hash(h).alias("hv"))
    older, newer = [bloom.build(keys.where(f"segment {half} 32"), ["segment", "barrel"]) for half in ("<", ">=")]
    boxes = bloom.merge_container(bloom.container(older), newer)
    probes = _probes(spark, d).select(F.col("user_id").alias("id"), (routing.barrel(h) % 64).alias("barrel"), routing.bloom_hash(h).alias("hv"))
    hits = bloom.match_segments(probes, boxes).select("id", F.explode("segments").alias("segment"))
    true = e.withColumnRenamed("user_id", "id").withColumn("held", F.lit(1))
    return hits.join(true, ["id", "segment"], "left").groupBy("segment").agg(F.count("*").alias("matches"), F.count("held").alias("held"))


QUERIES = {
    "q01_latest_events": latest_events, "q02_multi_get": multi_get, "q03_multi_get_hits": multi_get_hits, "q04_multi_get_misses": multi_get_misses,
    "q05_route": route, "q06_chain_and_order": chain_and_order, "q07_row_volume": row_volume, "q08_oversize_rows": oversize_rows, "q09_segment_fill": segment_fill,
    "q10_feed_prefix": feed_prefix, "q11_pick_fullest_child": pick_fullest_child, "q12_full_children": full_children, "q13_compaction_output": compaction_output,
    "q14_compaction_invariant": compaction_invariant, "q15_version_amplification": version_amplification, "q16_bloom_positions": bloom_positions,
    "q17_bloom_filter_bits": bloom_filter_bits, "q18_bloom_probe": bloom_probe, "q19_segment_bitmap": segment_bitmap, "q20_barrel_histogram": barrel_histogram,
    "q21_segment_report": segment_report, "q22_trie_rollup": trie_rollup, "q23_hit_level": hit_level, "q24_amplification": amplification,
    "q25_latency_histogram": latency_histogram, "q26_latency_percentiles": latency_percentiles, "q27_qps_report": qps_report, "q28_fnv_scramble": fnv_scramble,
    "q29_zipf_draws": zipf_draws, "q30_distribution_report": distribution_report, "q31_heavy_hitters": heavy_hitters, "q32_unit_map": unit_map,
    "q33_manifest_tree": manifest_tree, "q34_overflow_moves": overflow_moves, "q35_overflow_index": overflow_index, "q36_mixed_batches": mixed_batches,
    "q37_upsert_lineitem": upsert_lineitem, "q38_stream_latest": stream_latest, "q39_point_lookup": point_lookup, "q40_generator_draws": generator_draws,
    "q41_staged_read": staged_read,
    "q49_store_round_trip": store_round_trip, "q50_store_multi_get": store_multi_get, "q51_store_reopen": store_reopen,
    "q52_engine_report": engine_report, "q53_lookup_cost": lookup_cost, "q54_uncovered_overflow": uncovered_overflow,
    "q55_verbose_report": verbose_report, "q56_moved_histogram": moved_histogram, "q57_barrels_by_volume": barrels_by_volume,
    "q58_index_by_id": index_by_id, "q59_index_search": index_search, "q60_free_units": free_units, "q61_key_encodings": key_encodings,
    "q62_io_report": io_report, "q63_container_probe": container_probe,
}

def _fnv_sql() -> str:
    """One nested SELECT per octet keeps the running hash a column."""
    inner = "SELECT o_orderkey, CAST(14695981039346656037 AS HUGEINT) AS a FROM orders"
    for i in range(8):
        inner = f"SELECT o_orderkey, ((a - a % 256 + CAST(xor(CAST(a % 256 AS BIGINT), (o_orderkey >> {8 * i}) & 255) AS HUGEINT)) * 1099511628211) % 18446744073709551616 AS a FROM ({inner})"
    return f"SELECT o_orderkey, CAST(a % 2000 AS BIGINT) AS scrambled FROM ({inner})"


SQL = {
    "q01_latest_events": LATEST_EVENTS,
    "q02_multi_get": f"SELECT p.user_id, l.user_id IS NOT NULL AS found, event_id, value FROM ({PROBES}) p LEFT JOIN ({LATEST_EVENTS}) l ON p.user_id = l.user_id",
    "q03_multi_get_hits": f"SELECT user_id FROM ({PROBES}) p WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id)",
    "q04_multi_get_misses": f"SELECT user_id FROM ({PROBES}) p WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id)",
    "q05_route": f"SELECT o_orderkey, {PATH} AS path, {', '.join(f'CAST({_le(0, 1)} // {8**i} % 8 AS BIGINT) AS slot{i}' for i in range(4))}, {BARREL} AS barrel FROM ({ORDER_HASH})",
    "q06_chain_and_order": f"SELECT o_orderkey, CAST({_le(16, 19)} % 64 AS BIGINT) AS chain, CASE WHEN s = 0 THEN w ELSE ((w << s) & 4294967295) | (w >> (32 - s)) END AS move_order FROM (SELECT o_orderkey, h, CAST({BARREL} % 32 AS INTEGER) AS s, CAST({_le(12, 15)} AS BIGINT) AS w FROM ({ORDER_HASH}))",
    "q07_row_volume": "SELECT doc_id, CAST(k + v + CASE WHEN k < 128 THEN 1 WHEN k < 16384 THEN 2 ELSE 3 END + CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 ELSE 3 END AS BIGINT) AS volume FROM (SELECT doc_id, octet_length(encode(CAST(doc_id AS VARCHAR))) AS k, octet_length(encode(text)) AS v FROM documents)",
    "q09_segment_fill": f"SELECT seg, count(*) AS items, CAST(sum(volume) AS BIGINT) AS volume FROM ({EVENT_LOG}) GROUP BY seg",
    "q10_feed_prefix": FEED,
    "q11_pick_fullest_child": f"SELECT * FROM ({FEED}) ORDER BY nr_feed DESC, node LIMIT 1",
    "q12_full_children": f"SELECT node, count(*) AS segments FROM ({PLACED}) GROUP BY node HAVING count(*) >= 20",
    "q13_compaction_output": f"SELECT user_id, event_id, value, CAST({_le(0, 1, 'sha1(CAST(user_id AS VARCHAR))')} % 8 AS BIGINT) AS slot FROM ({LATEST_EVENTS})",
    "q14_compaction_invariant": LATEST_EVENTS,
    "q15_version_amplification": f"SELECT seg, count(*) AS stored, count(DISTINCT user_id) AS keys, round(CAST(count(*) AS DOUBLE) / count(DISTINCT user_id), 9) AS amplification FROM ({EVENT_LOG}) GROUP BY seg",
    "q16_bloom_positions": f"SELECT id AS o_orderkey, CAST(j AS INTEGER) AS j, {POS} AS pos FROM (SELECT id, hv, 1021 AS bits FROM ({BLOOM_KEYS})), range(0, 11) r(j)",
    "q17_bloom_filter_bits": f"SELECT barrel, max(bits) AS bits, count(*) AS set_bits FROM ({FILTERS}) GROUP BY barrel",
    "q18_bloom_probe": f"WITH f AS ({FILTERS}), k AS ({BLOOM_KEYS}), b AS (SELECT DISTINCT barrel, bits FROM f), a AS (SELECT DISTINCT id, barrel, {POS} AS pos FROM (SELECT id, k.barrel, hv, bits FROM k JOIN b ON k.barrel = b.barrel), range(0, 11) r(j)), m AS (SELECT a.id, count(f.pos) = count(*) AS ok FROM a LEFT JOIN f ON a.barrel = f.barrel AND a.pos = f.pos GROUP BY a.id) SELECT k.id % 2 = 0 AS present, count(*) AS probes, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS matches FROM k LEFT JOIN m ON k.id = m.id GROUP BY 1",
    "q19_segment_bitmap": f"SELECT user_id, event_id // 1000 // {WORD_BITS} AS word, bit_or(CAST(1 AS BIGINT) << CAST(event_id // 1000 % {WORD_BITS} AS INTEGER)) AS bitmap FROM events GROUP BY 1, 2",
    "q20_barrel_histogram": f"SELECT items, count(*) AS barrels FROM (SELECT {BARREL} AS barrel, count(*) AS items FROM ({ORDER_HASH}) GROUP BY 1) GROUP BY items",
    "q21_segment_report": f"SELECT seg, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS items, count(DISTINCT user_id) AS keys, round(CAST(sum(volume) AS DOUBLE) * 100.0 / 33554432, 9) AS percent FROM ({EVENT_LOG}) GROUP BY seg",
    "q22_trie_rollup": f"SELECT slot0, slot1, slot2, count(*) AS items FROM (SELECT {', '.join(f'CAST({_le(0, 1)} // {8**i} % 8 AS BIGINT) AS slot{i}' for i in range(3))} FROM ({ORDER_HASH})) GROUP BY ROLLUP (slot0, slot1, slot2)",
    "q23_hit_level": "SELECT k // 1000 % 5 AS level, count(*) AS hits FROM (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey) GROUP BY 1",
    "q24_amplification": "SELECT level, written, kept, round(CAST(written AS DOUBLE) / kept, 9) AS write_amp, round(CAST(probes - hits AS DOUBLE) * 100.0 / nullif(probes, 0), 9) AS miss_ratio FROM (SELECT event_id // 1000 % 3 AS level, count(*) AS written, count(DISTINCT user_id) AS kept, count(DISTINCT CASE WHEN user_id IN (SELECT c_custkey FROM customer) THEN user_id END) AS hits FROM events GROUP BY 1), (SELECT count(*) AS probes FROM customer)",
    "q25_latency_histogram": "WITH h AS (SELECT CAST(floor(value) AS BIGINT) AS bucket, count(*) AS count FROM events WHERE floor(value) >= 0 AND floor(value) < 100000 GROUP BY 1) SELECT bucket, count FROM h WHERE count > (SELECT sum(count) FROM h) // 1024",
    "q26_latency_percentiles": "WITH h AS (SELECT CAST(floor(value) AS BIGINT) AS bucket, count(*) AS c FROM events WHERE floor(value) >= 0 AND floor(value) < 100000 GROUP BY 1), r AS (SELECT bucket, sum(c) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS cum, (SELECT sum(c) FROM h) AS n FROM h) SELECT " + ", ".join(f"min(CASE WHEN cum >= n * {p} // 1000 THEN bucket END) AS p{p}" for p in (950, 990, 999)) + ", max(bucket) AS max_bucket FROM r",
    "q27_qps_report": "SELECT batch, ops, delta_usec, round(ops * 1e6 / nullif(CAST(delta_usec AS DOUBLE), 0), 6) AS qps FROM (SELECT batch, ops, until - lag(until) OVER (ORDER BY batch) AS delta_usec FROM (SELECT event_id // 1000 AS batch, count(*) AS ops, max(epoch_us(ts)) AS until FROM events GROUP BY 1))",
    "q28_fnv_scramble": _fnv_sql(),
    "q29_zipf_draws": _zipf_sql(),
    "q30_distribution_report": "WITH v AS (SELECT CAST(floor(value) AS BIGINT) AS v, row_number() OVER (ORDER BY value) - 1 AS i FROM events), n AS (SELECT count(*) AS n FROM events) SELECT pct, v AS value FROM range(5, 100, 5) r(pct), n, v WHERE v.i = n * pct // 100",
    "q31_heavy_hitters": f"WITH z AS ({_zipf_sql()}) SELECT draw, count(*) AS c FROM z GROUP BY draw HAVING count(*) >= (SELECT count(*) FROM z) // 100",
    "q32_unit_map": "SELECT o_orderkey // 64 AS line, rpad(string_agg(CASE WHEN o_orderstatus = 'F' THEN '*' ELSE '-' END, '' ORDER BY o_orderkey), 64, '#') AS map, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS used FROM orders GROUP BY 1",
    "q33_manifest_tree": MANIFEST,
    "q34_overflow_moves": MOVES,
    "q35_overflow_index": INDEX,
    "q36_mixed_batches": "SELECT e.event_id // 1000 AS batch, CAST(sum(CASE WHEN e.event_id % 100 < 60 THEN 1 ELSE 0 END) AS BIGINT) AS writes, CAST(sum(CASE WHEN e.event_id % 100 < 60 THEN 0 ELSE 1 END) AS BIGINT) AS reads, CAST(sum(CASE WHEN e.event_id % 100 >= 60 AND f.fw < e.event_id THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM events e LEFT JOIN (SELECT user_id, min(event_id) AS fw FROM events WHERE event_id % 100 < 60 GROUP BY user_id) f ON e.user_id = f.user_id GROUP BY 1",
    "q37_upsert_lineitem": "SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1",
    "q38_stream_latest": LATEST_EVENTS,
    "q39_point_lookup": f"SELECT * FROM ({LATEST_EVENTS}) WHERE user_id = 7",
    "q40_generator_draws": f"SELECT event_id, CAST(1984 AS BIGINT) AS c, CAST(20 + floor(u * 1980) AS BIGINT) AS uni, CAST(floor(-ln(greatest(u, 1.1641532182693481e-10)) / 0.02995732273553991) AS BIGINT) AS expo FROM (SELECT event_id, {U_ID} AS u FROM events)",
    "q41_staged_read": _staged_sql(),
}
SQL["q08_oversize_rows"] = f"SELECT * FROM ({SQL['q07_row_volume']}) WHERE volume > {BLOCK_BYTES}"
_USER = "sha1(CAST(user_id AS VARCHAR))"
_LAST = "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id"
SQL["q49_store_round_trip"] = _LAST
SQL["q50_store_multi_get"] = f"SELECT c_custkey AS user_id, l.user_id IS NOT NULL AS found, l.event_id FROM customer LEFT JOIN ({_LAST}) l ON c_custkey = l.user_id"
SQL["q51_store_reopen"] = f"""SELECT 1 AS level, CAST({_le(0, 1, _USER)} % 8 AS VARCHAR) AS path, count(*) AS items,
  CAST(sum(octet_length(encode(CAST(user_id AS VARCHAR))) + octet_length(encode(CAST(event_id AS VARCHAR))) + 2) AS BIGINT) AS volume FROM ({_LAST}) GROUP BY 2"""
SQL["q52_engine_report"] = f"""WITH p AS ({SQL['q18_bloom_probe']}), n AS (SELECT CAST(sum(CASE WHEN present THEN matches ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN present THEN 0 ELSE matches END) AS BIGINT) AS fp, CAST(sum(CASE WHEN present THEN 0 ELSE probes - matches END) AS BIGINT) AS tn FROM p)
SELECT tp, fp, tn, round(fp * 100.0::DOUBLE / nullif(fp + tp + tn, 0), 9) AS fp_percent, round(tp * 100.0::DOUBLE / nullif(tp + fp, 0), 9) AS fetch_efficiency, round((tp + fp) * 1.0::DOUBLE / nullif(tp, 0), 9) AS read_amp FROM n"""
SQL["q53_lookup_cost"] = f"SELECT r.barrel, r.items + coalesce(nr_out, 0) AS lookups FROM (SELECT barrel, count(*) AS items FROM ({LINE_ROWS}) GROUP BY barrel) r LEFT JOIN ({MOVES}) m ON r.barrel = m.barrel"
SQL["q54_uncovered_overflow"] = f"""SELECT lookups, moved, greatest(0, lookups * {COVER_PERCENT} // 100 - (lookups - moved)) AS todo FROM
  (SELECT CAST(sum(lookups) AS BIGINT) AS lookups FROM ({SQL['q53_lookup_cost']})), (SELECT CAST(coalesce(sum(nr_out), 0) AS BIGINT) AS moved FROM ({MOVES}))"""
SQL["q55_verbose_report"] = f"""SELECT items, lookups, covered, moved - covered AS lost, round((lookups - covered) * 1.0::DOUBLE / items, 9) AS avg_read FROM
  ({SQL['q54_uncovered_overflow']}), (SELECT CAST(coalesce(sum(nr_out), 0) AS BIGINT) AS covered FROM ({INDEX})), (SELECT count(*) AS items FROM lineitem)"""
SQL["q56_moved_histogram"] = f"SELECT nr_out, count(*) AS barrels FROM (SELECT r.barrel, coalesce(nr_out, 0) AS nr_out FROM (SELECT DISTINCT barrel FROM ({LINE_ROWS})) r LEFT JOIN ({MOVES}) m ON r.barrel = m.barrel) GROUP BY nr_out"
SQL["q57_barrels_by_volume"] = f"SELECT barrel, volume, CAST(row_number() OVER (ORDER BY volume, barrel) AS INTEGER) AS place FROM (SELECT barrel, CAST(sum(volume) AS BIGINT) AS volume FROM ({LINE_ROWS}) GROUP BY barrel)"
SQL["q58_index_by_id"] = f"SELECT barrel, nr_out, CAST(row_number() OVER (ORDER BY barrel) AS INTEGER) AS place FROM ({INDEX})"
SQL["q59_index_search"] = f"SELECT r.barrel, nr_out IS NOT NULL AS found, nr_out FROM (SELECT DISTINCT barrel FROM ({LINE_ROWS})) r LEFT JOIN ({INDEX}) i ON r.barrel = i.barrel"
SQL["q60_free_units"] = "SELECT units, used, units - used AS unused, round(used * 100.0::DOUBLE / units, 9) AS percent FROM (SELECT count(*) AS units, count(*) FILTER (o_orderstatus = 'F') AS used FROM orders)"
_HEX = "lpad(hex(o_orderkey), 16, '0')"
_OCTET = lambda i, more: f"lpad(hex((o_orderkey >> {7 * i}) & 127 | {128 * more}), 2, '0')"
SQL["q61_key_encodings"] = f"""SELECT o_orderkey, {' || '.join(f'substr({_HEX}, {2 * i + 1}, 2)' for i in range(7, -1, -1))} AS le, lower({_HEX}) AS txt,
  CASE {' '.join(f"WHEN o_orderkey < {128**k} THEN {' || '.join(_OCTET(i, i < k - 1) for i in range(k))}" for k in range(1, 9))} END AS varint, o_orderkey AS back FROM orders"""
SQL["q62_io_report"] = f"""SELECT ops, seconds, round(ops / nullif(seconds, 0), 9) AS iops, round(b / 1048576.0::DOUBLE, 9) AS mib, round(b / 1048576.0::DOUBLE / nullif(seconds, 0), 9) AS mib_per_sec FROM
  (SELECT count(*) AS ops, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE AS seconds, sum(octet_length(encode(CAST(user_id AS VARCHAR))) + octet_length(encode(CAST(event_id AS VARCHAR))) + 2) AS b FROM events)"""
_BOX = f"SELECT segment, user_id, CAST({BARREL.replace('(h,', '(' + _USER + ',')} % 64 AS BIGINT) AS barrel, {_le(12, 19, _USER)}::HUGEINT AS hv"
SQL["q63_container_probe"] = f"""WITH e AS (SELECT DISTINCT event_id // 1000 % {LEVEL_COUNT} AS segment, user_id FROM events), k AS ({_BOX} FROM e),
  s AS (SELECT segment, barrel, CAST(greatest(8, 2 * count(*)) * 8 - 3 AS BIGINT) AS bits FROM k GROUP BY 1, 2),
  f AS (SELECT DISTINCT k.segment, k.barrel, {POS} AS pos FROM k JOIN s ON k.segment = s.segment AND k.barrel = s.barrel, range(0, 11) r(j)),
  p AS ({_BOX} FROM (SELECT 0 AS segment, c_custkey AS user_id FROM customer)),
  a AS (SELECT DISTINCT user_id, s.segment, p.barrel, {POS} AS pos FROM p JOIN s ON p.barrel = s.barrel, range(0, 11) r(j)),
  m AS (SELECT a.user_id, a.segment FROM a LEFT JOIN f ON a.segment = f.segment AND a.barrel = f.barrel AND a.pos = f.pos GROUP BY 1, 2 HAVING count(f.pos) = count(*))
SELECT m.segment, count(*) AS matches, count(e.user_id) AS held FROM m LEFT JOIN e ON m.user_id = e.user_id AND m.segment = e.segment GROUP BY 1"""
