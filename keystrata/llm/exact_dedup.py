"""Exact dedup by content-defined chunk recipes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.session import checkpoint_dir

BLANKS = r"[\x20\x09-\x0D]+"
LEAST_CHUNK, MOST_CHUNK = 256, 4096
MOST_HOT = 1000  # groups of more than one in so many rows


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def chunks(text: Column, least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> Column:
    """Cuts past ``least`` characters behind the first that equals the third before it, at ``most`` at the latest.

    That test sees four characters and no position, in any script or code, so equal passages fall
    into equal chunks again soon after any difference.  The empty text is one empty chunk.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 4}}}?(.)..\1|.{{1,{most}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(pieces)


def _ranks(rows: DataFrame) -> DataFrame:
    """(h, digest, rank) of the digests whose 64-bit hash is that of another digest too; as a rule none."""
    each = rows.select(F.explode("chunks").alias("c")).select("c.h", "c.digest")
    clash = each.groupBy("h").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("h")
    rank = F.row_number().over(Window.partitionBy("h").orderBy("digest"))
    return each.join(clash, "h", "left_semi").distinct().select("h", "digest", rank.alias("rank")).checkpoint()


def _recipes(rows: DataFrame) -> DataFrame:
    """Rows with ``recipe``, the list of their chunks' identifiers, in place of ``chunks``.

    An identifier is the chunk's hash, which comparing the digests of each hash has verified to
    stand for one content, or hash and rank where it stands for several.
    """
    plain = rows.withColumn("recipe", F.transform("chunks", lambda c: F.struct(c.h.alias("h"), F.lit(1).alias("rank"))))
    ranks = _ranks(rows)
    if ranks.isEmpty():
        return plain.drop("chunks")
    every = rows.select("row", F.posexplode("chunks").alias("pos", "c")).select("row", "pos", "c.h", "c.digest")
    in_order = F.sort_array(F.collect_list(F.struct("pos", "h", "rank")))
    named = every.join(ranks, ["h", "digest"], "left").withColumn("rank", F.coalesce("rank", F.lit(1))).groupBy("row").agg(in_order.alias("r"))
    listed = named.select("row", F.transform("r", lambda x: F.struct(x.h, x["rank"])).alias("recipe"))
    return rows.drop("chunks").join(listed, "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHUNK, most: int = MOST_CHUNK, hash_of=F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are cut into chunks once; their hashes and digests are checkpointed, and texts are not
    needed again.  Documents are equal when their ordered lists of verified chunk identifiers are.
    Groups are counted by a map-side combined aggregate; the result of groups of more than one in
    ``MOST_HOT`` rows comes back by broadcast (fewer than that many, so that their recipes are at
    most ``MOST_HOT`` times the mean recipe), of the others by a join.

    Null and empty texts are equal to each other.  Among rows that repeat both id and text, one is
    kept.  A null id sorts after all others; a group of null ids only has a null keep_id.  An empty
    table gives an empty result; other columns are ignored.
    """
    checkpoint_dir(docs.sparkSession)
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    told = F.transform(chunks(F.col("t"), least, most), lambda c: F.struct(hash_of(c).alias("h"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("digest")))
    rows = norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), told.alias("chunks")).checkpoint()
    recipes = _recipes(rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = recipes.groupBy("recipe").agg(first, F.count("*").alias("group_size")).select("recipe", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    hot = F.col("group_size") > F.lit(max(1000, rows.count() // MOST_HOT))
    named = recipes.join(F.broadcast(groups.where(hot)), "recipe", "left").select(recipes["*"], "keep_id", "keep_row", "group_size")
    done = named.where("keep_row is not null")
    rest = named.where("keep_row is null").drop("keep_id", "keep_row", "group_size").join(groups.where(~hot), "recipe")
    out = done.unionByName(rest)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.size("recipe").alias("n_chunks"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     h AS (SELECT doc_id, t, sha256(t) AS text_sha256 FROM n),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY t)
SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id AS kept, h.text_sha256
FROM h JOIN g ON h.t = g.t
"""
}
