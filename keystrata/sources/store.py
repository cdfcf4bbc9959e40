"""On-disk store: immutable Parquet segments under a versioned manifest.

    segments/<mtid % 256 in hex>/<mtid in hex>/          a put: key, value, seq; sorted, with a bloom filter
    segments/<mtid % 256 in hex>/<mtid in hex>/slot=<k>/ a compaction: the segments of its children
    manifest/v=<n>                                       segments, sequence, streams and configuration

Writers are single; readers see the highest manifest version.  A version is written aside and gets
its name by one rename, which fails if another writer was first; a writer that stops before it
leaves the version before in force.  Old segments and manifests go only by `vacuum`.
"""

from __future__ import annotations

import hashlib
import json
import logging
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keystrata.config import BLOCK_BYTES, FANOUT, LEVELS, Config
from keystrata.functions import routing
from keystrata.operators import merge

log = logging.getLogger(__name__)
ROW = "key binary, value binary, seq bigint"
KEPT_MANIFESTS = 10
MAX_PATHS = 8 ** (LEVELS - 1)


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.is_compacting = False
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None) -> Store:
        """Opens the store with its own configuration or the one given, or creates an empty one.

        Data without a manifest is an error.
        """
        store = cls(spark, path, config or Config())
        if not store._versions():
            if store._exists("segments"):
                raise ValueError(f"{path} has segments but no manifest")
            store._publish({"version": 0, "next_mtid": 1, "next_seq": 0, "streams": {}, "segments": []})
        elif config is None:
            held = store.manifest()["config"]
            store.config = Config(**{**held, "level_paths": tuple(held["level_paths"])})
        return store

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._Path(f"{self.path}/{name}"))

    def _versions(self) -> list[int]:
        if not self._exists("manifest"):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._Path(f"{self.path}/manifest"))]
        return sorted(int(x[2:]) for x in names if x.startswith("v="))

    def _publish(self, manifest: dict) -> None:
        aside, named = (f"{self.path}/manifest/{x}{manifest['version']}" for x in (".next-", "v="))
        out = self._fs.create(self._Path(aside), True)
        out.write(bytearray(json.dumps({**manifest, "config": asdict(self.config)}).encode()))
        out.close()
        if self._fs.exists(self._Path(named)) or not self._fs.rename(self._Path(aside), self._Path(named)):
            raise RuntimeError(f"{named} is there already: another writer was first")

    def manifest(self) -> dict:
        stream = self._fs.open(self._Path(f"{self.path}/manifest/v={self._versions()[-1]}"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def segment_path(self, mtid: int, level: int = 0) -> str:
        return f"{self._base(level)}/segments/{mtid % 256:02x}/{mtid:016x}"

    def _base(self, level: int) -> str:
        return self.config.level_paths[level] if level < len(self.config.level_paths) else self.path

    def _write(self, rows: DataFrame, mtid: int, level: int, path: str, slots: list[int | None], files: int) -> list[dict]:
        """Writes one segment, or the segments of all children, in one job that also counts them."""
        at, seen, told = self.segment_path(mtid, level), Observation(), []
        for k in slots:
            mine = F.lit(True) if k is None else F.col("slot") == k
            told += [F.count_if(mine).alias(f"items{k}"), F.sum(F.when(mine, routing.volume(F.col("key"), F.col("value")))).alias(f"volume{k}"), F.min(F.when(mine, F.col("seq"))).alias(f"low{k}"), F.max(F.when(mine, F.col("seq"))).alias(f"high{k}")]
        by = [c for c in rows.columns if c == "slot"]
        barrel = routing.barrel(routing.digest(F.col("key")))
        placed = rows.withColumn("barrel", barrel).repartition(files * len(slots), *by, F.pmod("barrel", F.lit(files))).sortWithinPartitions(*by, "barrel", "key").drop("barrel")
        writer = placed.observe(seen, *told).write.mode("overwrite")
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", self.config.bloom_ndv)
        (writer.partitionBy(*by) if by else writer).parquet(at)
        got, out = seen.get, []
        for i, k in enumerate(slots):
            log.info("segment %016x level %d path %r: %d rows", mtid + i, level, path, got[f"items{k}"])
            if got[f"items{k}"]:
                where = at if k is None else f"{at}/slot={k}"
                out.append({"mtid": mtid + i, "level": level, "path": path if k is None else f"{path}{k}", "at": where, "items": got[f"items{k}"], "volume": got[f"volume{k}"], "low": got[f"low{k}"], "high": got[f"high{k}"]})
        return out

    def _files(self, volume: int) -> int:
        """Files of a segment: each about as large as a full segment of the layout."""
        return max(1, -(-volume // self.config.segment_bytes))

    def put(self, rows: DataFrame, batch_id: int | None = None, stream: str = "", order: Column | str | None = None, files: int = 1) -> int:
        """Commits one batch of (key, value[, seq]) as one segment and returns its id.

        The whole batch becomes visible at once.  Without ``seq`` the batch is newer than all that
        was put before, and of rows with one key the last in ``order`` counts; without ``order`` a
        key that comes twice is an error.  With ``seq`` the largest counts, of equal ones the larger
        value.  Empty or null keys, null values and rows above a block are errors.  A batch id that
        the same stream has committed before is skipped, and -1 returned.
        """
        m = self.manifest()
        if batch_id is not None and batch_id <= m["streams"].get(stream, -1):
            return -1
        mtid = m["next_mtid"]
        key, value = F.col("key").cast("binary"), F.col("value").cast("binary")
        has_seq = "seq" in rows.columns
        seq = F.col("seq").cast("bigint") if has_seq else F.lit(m["next_seq"]).cast("bigint")
        rank = seq if has_seq else F.lit(0) if order is None else F.col(order) if isinstance(order, str) else order
        bad = key.isNull() | value.isNull() | (F.octet_length(key) == 0) | (routing.volume(key, value) > BLOCK_BYTES)
        checked = rows.select(F.when(bad, F.raise_error(F.lit("row has an empty key, no value, or is larger than a block"))).otherwise(key).alias("key"), value.alias("value"), seq.alias("seq"), rank.alias("rank"))
        newest = checked.groupBy("key").agg(F.max(F.struct("rank", "value", "seq")).alias("r"), F.count("*").alias("n"))
        if not has_seq and order is None:
            newest = newest.withColumn("n", F.when(F.col("n") > 1, F.raise_error(F.lit("a key comes twice in a batch without seq or order"))).otherwise(F.col("n"))).where("n = 1")
        added = self._write(newest.select("key", "r.value", "r.seq"), mtid, 0, "", [None], files)
        streams = m["streams"] if batch_id is None else {**m["streams"], stream: batch_id}
        next_seq = max([m["next_seq"], *(s["high"] + 1 for s in added)])
        self._publish({**m, "version": m["version"] + 1, "next_mtid": mtid + 1, "next_seq": next_seq, "streams": streams, "segments": m["segments"] + added})
        return mtid

    def scan(self, segments: list[dict] | None = None) -> DataFrame:
        """All stored versions of the given segments, or of all."""
        paths = [s["at"] for s in (self.manifest()["segments"] if segments is None else segments)]
        return self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)

    def latest(self) -> DataFrame:
        return merge.latest(self.scan(), ["key"], "seq")

    def on_paths(self, paths: list[str]) -> list[dict]:
        """Segments that keys with these leaf paths may be in."""
        wanted = {p[:i] for p in paths for i in range(LEVELS)}
        return [s for s in self.manifest()["segments"] if s["path"] in wanted]

    def get(self, key: bytes) -> bytes | None:
        """Value of one key, or None; only segments on the key's path are read, with the key pushed down."""
        bits = int.from_bytes(hashlib.sha1(key).digest()[:2], "little")
        some = self.on_paths(["".join(str(bits >> (3 * i) & 7) for i in range(LEVELS - 1))])
        row = self.scan(some).where(F.col("key") == F.lit(bytearray(key))).agg(F.max_by("value", "seq").alias("v"), F.count("*").alias("n")).first()
        return bytes(row.v) if row.n else None

    def multi_get(self, probes: DataFrame) -> DataFrame:
        """Every probe with ``found`` and ``value``.

        Only segments on a probe's path are read (there are at most 4,096 leaf paths), and versions
        of keys that nobody asked for go before the newest are found.
        """
        keys = probes.select(F.col("key").cast("binary").alias("key"))
        leaf = routing.node_path(routing.digest(F.col("key")), LEVELS - 1)
        paths = [r.p for r in keys.where("key is not null").select(leaf.alias("p")).distinct().limit(MAX_PATHS).collect()]  # there are no more
        return merge.multi_get(probes, self.scan(self.on_paths(paths)), "key", "seq").select(*probes.columns, "found", "value")

    def _fed(self, held: list[dict], full: bool) -> list[dict]:
        """The oldest segments of a node that a compaction takes: as many as reach the feed size."""
        run = 0
        for i, s in enumerate(held):
            run += s["volume"]
            if run >= self.config.feed_bytes:
                return held[: i + 1]
        return held if full or len(held) >= self.config.most_segments else []

    def _nodes(self, m: dict) -> dict[tuple[int, str], list[dict]]:
        nodes: dict[tuple[int, str], list[dict]] = {}
        for s in m["segments"]:
            nodes.setdefault((s["level"], s["path"]), []).append(s)
        return nodes

    def compact(self, full: bool = False) -> bool:
        """Merges the oldest segments of the first node that is due into its children.

        A node is due when the feed size or the segment limit is reached, or always with ``full``.
        The children only get new segments; the last level is never merged.
        """
        m = self.manifest()
        for (level, path), held in sorted(self._nodes(m).items()):
            fed = self._fed(held, full) if level < LEVELS - 1 else []
            if fed:
                self._compact(m, level, path, fed)
                return True
        return False

    def compact_down(self, level: int = 0, path: str = "") -> int:
        """Compacts a node that is due, then its fullest child and all that follow from it, then every other full child.

        Returns the number of compactions.
        """
        m = self.manifest()
        fed = self._fed(self._nodes(m).get((level, path), []), False) if level < LEVELS - 1 else []
        if not fed:
            return 0
        self._compact(m, level, path, fed)
        kids = {p: held for (lv, p), held in self._nodes(self.manifest()).items() if lv == level + 1 and p.startswith(path)}
        fullest = sorted(kids, key=lambda p: (-len(self._fed(kids[p], False)), p))
        return 1 + sum(self.compact_down(level + 1, p) for p in fullest)

    def _compact(self, m: dict, level: int, path: str, fed: list[dict]) -> None:
        self.is_compacting = True
        try:
            slot = routing.slot(routing.digest(F.col("key")), level)
            merged = merge.compact(self.scan(fed), ["key"], "seq", slot)
            files = self._files(sum(s["volume"] for s in fed) // FANOUT)
            added = self._write(merged, m["next_mtid"], level + 1, path, list(range(FANOUT)), files)
            gone = {s["mtid"] for s in fed}
            self._publish({**m, "version": m["version"] + 1, "next_mtid": m["next_mtid"] + FANOUT, "segments": [s for s in m["segments"] if s["mtid"] not in gone] + added})
        finally:
            self.is_compacting = False

    def vacuum(self) -> int:
        """Deletes segments that the current manifest does not name, and old manifests; returns the number of segments."""
        m = self.manifest()
        live, n = {s["at"] for s in m["segments"]}, 0
        for base in {self._base(level) for level in range(LEVELS)}:
            for at in self._fs.globStatus(self._Path(f"{base}/segments/*/*")) or []:
                folder = f"{base}/segments/{at.getPath().getParent().getName()}/{at.getPath().getName()}"
                kids = [f"{folder}/{x.getPath().getName()}" for x in self._fs.listStatus(at.getPath()) if x.getPath().getName().startswith("slot=")]
                dead = [x for x in kids or [folder] if x not in live]
                n += len(dead)
                for x in [folder] if kids and len(dead) == len(kids) else dead:
                    self._fs.delete(self._Path(x), True)
        for v in self._versions()[:-KEPT_MANIFESTS]:
            self._fs.delete(self._Path(f"{self.path}/manifest/v={v}"), False)
        return n

    def report(self) -> DataFrame:
        """One row per segment: mtid, level, path, items, volume, percent of a full segment, is_full."""
        rows = self.manifest()["segments"]
        schema = "mtid bigint, level int, path string, items bigint, volume bigint, low bigint, high bigint"
        df = self.spark.createDataFrame([tuple(s[k] for k in ("mtid", "level", "path", "items", "volume", "low", "high")) for s in rows], schema)
        return df.withColumn("percent", F.round(F.col("volume") * 100.0 / self.config.segment_bytes, 6)).withColumn("is_full", F.col("volume") >= self.config.segment_bytes)

    def close(self) -> dict:
        """Nothing is buffered: every put is committed.  Returns the configuration for the log."""
        return asdict(self.config)
