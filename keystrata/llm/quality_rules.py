"""Quality rules: base counts, and robust multivariate outliers per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import words as W
from keystrata.session import checkpoint_dir

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
N_STATS = 6
# Least standard deviation of each transformed statistic: smaller spreads are no ground to reject.
FLOOR = np.array([0.10, 0.55, 0.06, 0.04, 0.35, 0.35])
CORE = 0.75  # share of a group that the determinant is minimised over
STEPS = 3
SALTS = 64
SHRINK = 100.0  # rows that the wider group's estimate weighs in a group's
# Quantiles of the chi-square distribution with N_STATS degrees of freedom.
CHI2 = {"median": 5.348, "0.975": 14.449, "1-1e-7": 43.34}


def _statistics(words: W.Words) -> tuple[list[np.ndarray], np.ndarray]:
    """The base counts of each row, and its transformed statistics."""
    n_rows, n = words.n_rows, words.counts()
    row_of = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])[words.offsets])
    lead = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80, dtype=np.int64)])
    chars = np.bincount(words.row, weights=lead[words.ends] - lead[words.starts], minlength=n_rows).astype(np.int64)
    symbols = row_of(SYMBOLS[words.data])
    upper = row_of((words.data >= 65) & (words.data <= 90))
    digits = row_of((words.data >= 48) & (words.data <= 57))
    at, h = W.windows(words, 3)
    _, back, times = np.unique(h + words.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
    twice = at[times[back] > 1] if len(at) else at
    cover = np.bincount(twice, minlength=len(words.row) + 4)[: len(words.row) + 4] - np.concatenate([[0, 0, 0], np.bincount(twice, minlength=len(words.row) + 4)])[: len(words.row) + 4]
    repeat = np.bincount(words.row, weights=np.cumsum(cover)[: len(words.row)] > 0, minlength=n_rows).astype(np.int64)
    dup, data = np.zeros(n_rows, np.int64), words.data.tobytes()
    n_lines = np.ones(n_rows)
    for r, (s, e) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)):
        lines = data[s:e].split(b"\n")
        n_lines[r] = len(lines)
        if len(lines) > 1:
            seen: set[bytes] = set()
            for x in lines:
                if x in seen:
                    dup[r] += bool(x.strip(b" \t\x0b\x0c\r"))
                else:
                    seen.add(x)
    full = np.maximum(1, n)
    wide = np.maximum(1, chars)
    x = np.stack([np.log(wide / full), np.log1p(100 * symbols / full), upper / wide, digits / wide, np.log1p(10 * dup / n_lines), np.log1p(10 * repeat / full)], axis=1)
    return [n, chars, symbols, dup, repeat], x


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            counts, x = _statistics(W.split(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), part.column("source"), *(pa.array(c, pa.int64()) for c in counts), pa.array(list(x), pa.list_(pa.float64()))],
                ["doc_id", "lang", "source", *COUNTS, "x"],
            )


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, parent, n, s1, s2, the parent's centre and cov) to (k, centre, cov, inverse).

    A group's mean and covariance are those of its rows and of ``SHRINK`` rows like the parent's;
    the covariance gets the floor on its diagonal before it is inverted.
    """
    for batch in batches:
        out: dict[str, list] = {"centre": [], "cov": [], "inverse": []}
        for n, s1, s2, m0, c0 in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
            m, cov = np.array(s1) / n, np.array(s2).reshape(N_STATS, N_STATS) / n
            cov = cov - np.outer(m, m)
            if m0 is not None:
                w = n / (n + SHRINK)
                m, cov = w * m + (1 - w) * np.array(m0), w * cov + (1 - w) * np.array(c0).reshape(N_STATS, N_STATS)
            out["centre"].append(m.tolist())
            out["cov"].append(cov.ravel().tolist())
            out["inverse"].append(np.linalg.inv(cov + np.diag(FLOOR**2)).ravel().tolist())
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x in out.values())], ["k", *out])


def _distance(x, centre, inverse):
    """Squared Mahalanobis distance."""
    d = [F.get(x, i) - F.get(centre, i) for i in range(N_STATS)]
    return sum(d[i] * d[j] * F.get(inverse, i * N_STATS + j) for i in range(N_STATS) for j in range(N_STATS))


def _moments(rows: DataFrame) -> DataFrame:
    one = [F.sum(F.get("x", i)) for i in range(N_STATS)]
    two = {(i, j): F.sum(F.get("x", i) * F.get("x", j)) for i in range(N_STATS) for j in range(i, N_STATS)}
    flat = [two[min(i, j), max(i, j)] for i in range(N_STATS) for j in range(N_STATS)]
    return rows.groupBy("key").agg(F.count("*").cast("double").alias("n"), F.array(*one).alias("s1"), F.array(*flat).alias("s2"))


def _with_model(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Rows with their group's model, whose hot groups are split: each row meets one of ``SALTS`` copies of a model."""
    copies = model.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("s", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(copies, ["key", "s"])


def minimum_covariance(rows: DataFrame, wider: DataFrame | None = None, steps: int = STEPS) -> DataFrame:
    """(key, n, centre, cov, inverse, scale) per key of ``rows`` (key, parent, x): the MCD estimate.

    Starts from coordinate medians and quartile ranges; each concentration step keeps the ``CORE``
    share with the smallest distances and takes its mean and covariance, which never raises the
    determinant.  ``scale`` makes the median distance the chi-square median.  With ``wider``, the
    estimates of the parents, a group's estimate is drawn to its parent's by a weight that falls
    smoothly with the group's size.  All steps are map-side combined sums and quantile sketches
    over all rows; no group is gathered, and models are joined in salted copies.
    """
    schema = "key string, centre array<double>, cov array<double>, inverse array<double>"
    q = rows.groupBy("key").agg(F.max("parent").alias("parent"), F.count("*").cast("double").alias("n"), *[F.percentile_approx(F.get("x", i), [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(N_STATS)])
    spread = [F.pow((F.get(f"q{i}", 2) - F.get(f"q{i}", 0)) / 1.349, F.lit(2)) for i in range(N_STATS)]
    cov = F.array(*[spread[i] if i == j else F.lit(0.0) for i in range(N_STATS) for j in range(N_STATS)])
    centre = F.array(*[F.get(f"q{i}", 1) for i in range(N_STATS)])
    first = q.select("key", "parent", "n", centre.alias("m"), cov.alias("c")).checkpoint()
    parents = first.select("key", "parent")
    if wider is not None:
        parents = parents.join(wider.select(F.col("key").alias("parent"), F.col("centre").alias("m0"), F.col("cov").alias("c0"), F.col("scale").alias("s0")), "parent", "left").checkpoint()
    else:
        parents = parents.select("key", "parent", *[F.lit(None).cast(t).alias(c) for c, t in (("m0", "array<double>"), ("c0", "array<double>"), ("s0", "double"))])

    def fitted(sums: DataFrame) -> DataFrame:
        return sums.join(parents, "key").select("key", "n", "s1", "s2", "m0", "c0").mapInArrow(_fit, schema)

    m = lambda i, j: F.get("m", i) * F.get("m", j)
    sums = first.select("key", "n", F.transform("m", lambda x: x * F.col("n")).alias("s1"), F.array(*[(F.get("c", i * N_STATS + j) + m(i, j)) * F.col("n") for i in range(N_STATS) for j in range(N_STATS)]).alias("s2"))
    for step in range(steps + 1):
        model = fitted(sums).checkpoint()
        far = _with_model(rows.select("key", "x"), model).withColumn("d", _distance(F.col("x"), F.col("centre"), F.col("inverse"))).select("key", "x", "d")
        cuts = far.groupBy("key").agg(F.percentile_approx("d", [CORE, 0.5], 5000).alias("q")).select("key", F.get("q", 0).alias("cut"), (F.get("q", 1) / CHI2["median"]).alias("scale")).checkpoint()
        if step < steps:
            sums = _moments(_with_model(far, cuts).where("d <= cut").select("key", "x"))
    w = F.col("n") / (F.col("n") + SHRINK)
    scale = F.when(F.col("s0").isNull(), F.col("scale")).otherwise(w * F.col("scale") + (1 - w) * F.col("s0"))
    return model.join(cuts, "key").join(first.select("key", "n"), "key").join(parents.select("key", "s0"), "key").select("key", "n", "centre", "cov", "inverse", F.greatest(scale, F.lit(1.0)).alias("scale")).checkpoint()


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, distance, kept.

    The method judges rows that pass the base rules, each by the estimate of its own language and
    source.  That estimate weighs the rows of the group against ``SHRINK`` rows like its language's,
    and a language's against as many like all, so that small groups are judged nearly as their
    language is, and there is no size at which the rule changes.  A row is rejected when its squared
    distance exceeds the chi-square quantile at 1 - 1e-7, on whatever side of the group's centre: no
    statistic makes up for another.

    Null and empty texts have no words and fail the base rules; null language or source is a value
    like any other; equal rows get equal verdicts; a null id stays null.  An empty table gives an
    empty result; other columns are ignored.
    """
    checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    stats = rows.mapInArrow(W.tidy(_map), "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    name = lambda *c: F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), x), F.lit("-")) for x in c])
    stats = stats.select("doc_id", *COUNTS, "x", name(F.col("lang")).alias("language"), name(F.col("lang"), F.col("source")).alias("key")).withColumn("base_failed", failed).checkpoint()
    judged = stats.where(~F.col("base_failed"))
    everything = minimum_covariance(judged.select(F.lit("").alias("key"), F.lit(None).cast("string").alias("parent"), "x"))
    languages = minimum_covariance(judged.select(F.col("language").alias("key"), F.lit("").alias("parent"), "x"), everything)
    groups = minimum_covariance(judged.select("key", F.col("language").alias("parent"), "x"), languages)
    distance = _distance(F.col("x"), F.col("centre"), F.col("inverse")) / F.col("scale")
    both = _with_model(judged, groups).withColumn("distance", distance)
    none = stats.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    cols = ["doc_id", *COUNTS, "base_failed", "distance", "x", "key"]
    out = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > CHI2["1-1e-7"], F.lit(False))
    return both.select(*cols).unionByName(none.select(*cols)).withColumn("kept", out).select("doc_id", *COUNTS, "base_failed", "kept", "distance", "x", "key")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *COUNTS, "base_failed", "kept")
