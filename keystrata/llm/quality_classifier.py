"""Quality classifier: gated-attention multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import words as W

PASSAGE = 64
MOST_ROWS = 2500  # labelled documents that training takes, at most
MOST_PASSAGES = 64  # passages of a document that training takes, evenly spaced; scores come of all
THRESHOLD = 0.7
BUCKETS = 1 << 12  # of hashed words and word ends

_FIELD = 21  # bits; three counters share one 64-bit running sum, read back by differences
_CLASSES = [range(65, 91), range(97, 123), range(128, 256), range(48, 58), b"#*$%&<>", b"|", b".,;:", b"!?"]
_PACKED = np.zeros((3, 256), dtype=np.uint64)
for _i, _set in enumerate(_CLASSES):
    _PACKED[_i // 3, list(_set)] = 1 << (_FIELD * (_i % 3))
N_FEATURES = 13


def _tokens(words: W.Words) -> np.ndarray:
    """Two buckets for each word: of the word, and of its last three bytes (lower-cased A-Z)."""
    data, last = W.LOWER[words.data], words.ends - 1
    end = np.zeros(len(last), np.uint64)
    for k in range(3):
        at = last - k
        end = end * np.uint64(256) + np.where(at >= words.starts, data[np.maximum(at, 0)], 0).astype(np.uint64)
    own = W.mix(words.hash + np.uint64(3)) % np.uint64(BUCKETS)
    return np.stack([own, W.mix(end + np.uint64(9)) % np.uint64(BUCKETS)], axis=1).astype(np.uint16)


def passages(words: W.Words, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each passage, its features, its count of words, buckets of all words in order).

    Passages are runs of ``size`` words; a row has one at least.
    """
    counts = words.counts()
    per_row = np.maximum(1, -(-counts // size))
    row = np.repeat(np.arange(words.n_rows), per_row)
    x = np.zeros((len(row), N_FEATURES), dtype=np.float32)
    if not len(words.row):
        return row, x, np.zeros(len(row), np.int64), np.zeros((0, 2), np.uint16)
    within = np.arange(len(words.row)) - np.repeat(words.row_starts()[:-1], counts)
    at = np.concatenate([[0], np.cumsum(per_row)])[words.row] + within // size
    held, first = np.unique(at, return_index=True)  # rows without words have a passage without any
    first = np.append(first, len(at))
    n, length = len(row), words.ends - words.starts
    n_words = np.bincount(at, minlength=n)
    n_bytes = np.maximum(1, np.bincount(at, weights=length, minlength=n))
    full = np.maximum(1, n_words)
    head, tail = words.starts[first[:-1]], words.ends[first[1:] - 1]
    is_wide = int((tail - head).max()) >= 2**_FIELD  # a counter would run over into the next
    for k in range(3):
        mine = range(3 * k, min(3 * k + 3, 8))
        totals = [np.cumsum(np.isin(np.arange(256), list(_CLASSES[i]))[words.data], dtype=np.uint64) << np.uint64(_FIELD * (i % 3)) for i in mine] if is_wide else [np.cumsum(_PACKED[k][words.data])] * len(mine)
        for i, total in zip(mine, totals, strict=True):
            total = np.concatenate([np.zeros(1, np.uint64), total])
            some = (total[tail] - total[head]) >> np.uint64(_FIELD * (i % 3))
            x[held, i] = (some if is_wide else some & np.uint64(2**_FIELD - 1)) / n_bytes[held]
    x[:, 8] = n_bytes / full / 10
    x[:, 9] = np.bincount(at, weights=length <= 3, minlength=n) / full
    key = words.hash + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, once = np.unique(key, return_index=True)
    x[:, 10] = 1 - np.bincount(at[once], minlength=n) / full
    x[:, 11] = np.bincount(at, weights=np.square(length), minlength=n) / full / 100
    x[:, 12] = n_words / size
    return row, x, n_words, _tokens(words)


class Bags:
    """Documents as bags of passages: features, words of a passage, buckets of the words."""

    def __init__(self, bag: np.ndarray, x: np.ndarray, n_words: np.ndarray, tokens: np.ndarray):
        self.bag, self.x, self.n = bag, x, int(bag[-1]) + 1 if len(bag) else 0
        self.at = np.repeat(np.arange(len(bag), dtype=np.int32), n_words)
        self.tokens, self.share = tokens, 0.5 / np.maximum(1, n_words)

    def means(self, table: np.ndarray) -> np.ndarray:
        """Mean embedding of a passage's words and word ends, for a table of dimensions by buckets."""
        out = np.empty((len(self.bag), len(table)))
        for j, one in enumerate(table):
            out[:, j] = np.bincount(self.at, weights=one[self.tokens[:, 0]] + one[self.tokens[:, 1]], minlength=len(self.bag))
        return out * self.share[:, None]

    def back(self, grad: np.ndarray) -> np.ndarray:
        """Gradient of the table from that of the means."""
        out = np.empty((grad.shape[1], BUCKETS))
        for j in range(grad.shape[1]):
            each = (grad[:, j] * self.share)[self.at]
            out[j] = np.bincount(self.tokens[:, 0], weights=each, minlength=BUCKETS) + np.bincount(self.tokens[:, 1], weights=each, minlength=BUCKETS)
        return out


class Attention:
    """score = sigmoid(c.z + b), z = sum of softmax(w.(tanh(Vh) * sigm(Uh))) h over a document's passages.

    A passage's vector is h = tanh(Wx + Qe + a): x are its statistics, e the mean of the learned
    embeddings of its hashed words and word ends.
    """

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = 16, gate: int = 8, embed: int = 6, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        self.mean, self.scale = mean, scale
        self.p = {"W": draw(len(mean), hidden), "a": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "b": np.zeros(1), "Q": draw(embed, hidden), "E": np.zeros((embed, BUCKETS))}

    def forward(self, bags: Bags) -> tuple:
        p, n, bag = self.p, bags.n, bags.bag
        x = np.clip((bags.x - self.mean) / self.scale, -8, 8)
        e = bags.means(p["E"])
        h = np.tanh(x @ p["W"] + e @ p["Q"] + p["a"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        g = np.exp(np.clip((t * s) @ p["w"], -30, 30))
        alpha = g / np.bincount(bag, weights=g, minlength=n)[bag]
        z = np.stack([np.bincount(bag, weights=alpha * h[:, j], minlength=n) for j in range(h.shape[1])], axis=1)
        return x, e, h, t, s, alpha, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))

    def score(self, bags: Bags) -> np.ndarray:
        return self.forward(bags)[-1] if bags.n else np.zeros(0)

    def fit(self, bags: Bags, y: np.ndarray, steps: int = 100, rate: float = 0.03, decay: float = 2e-4) -> Attention:
        """Full-batch Adam on the log loss; bags hold consecutive rows."""
        n, p, bag = len(y), self.p, bags.bag
        m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            xs, e, h, t, s, alpha, z, out = self.forward(bags)
            d = (out - y) / n
            dz = d[:, None] * p["c"]
            dh = alpha[:, None] * dz[bag]
            da = (h * dz[bag]).sum(1)
            ds = alpha * (da - np.bincount(bag, weights=alpha * da, minlength=n)[bag])
            dt, dg = ds[:, None] * p["w"] * s * (1 - t**2), ds[:, None] * p["w"] * t * s * (1 - s)
            dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
            grad = {"W": xs.T @ dh, "a": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * s).T @ ds, "c": z.T @ d, "b": np.array([d.sum()]), "Q": e.T @ dh, "E": bags.back(dh @ p["Q"].T)}
            for k in p:
                g = grad[k] + decay * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id) -> object:
    """The fold that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, y, x, n, tokens): features, counts of words and buckets of at most ``MOST_PASSAGES`` passages of a row."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            row, x, n_words, tokens = passages(W.split(part.column("text")))
            cuts, ends = np.searchsorted(row, np.arange(part.num_rows + 1)), np.concatenate([[0], np.cumsum(n_words)])
            out: list[list[bytes]] = [[], [], []]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                some = np.unique(np.linspace(s, e - 1, min(MOST_PASSAGES, e - s)).astype(np.int64))
                out[0].append(x[some].astype("<f4").tobytes())
                out[1].append(n_words[some].astype("<i8").tobytes())
                out[2].append(np.concatenate([tokens[ends[i] : ends[i + 1]] for i in some]).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), *(pa.array(o, pa.binary()) for o in out)], ["k", "y", "x", "n", "tokens"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> Attention | None:
    """Learns from at most ``most_rows`` labelled documents outside the held-out fold, chosen by hash.

    Only labels of ids in ``docs`` count; ids that are labelled twice with different marks are left
    out, and of rows that repeat an id one is taken.  None without rows to learn from.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").select("k", F.col("y").cast("double").alias("y"))
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text"))
    chosen = F.broadcast(marked.join(rows.select("k"), "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(most_rows))  # at most most_rows small rows
    told = rows.join(chosen, "k").select("k", "y", "text").mapInArrow(W.tidy(_encode), "k long, y double, x binary, n binary, tokens binary")
    got = told.groupBy("k").agg(F.min(F.struct(F.xxhash64("x", "tokens").alias("h"), "x", "n", "tokens", "y")).alias("r")).select("k", "r.*").toArrow().sort_by("k")  # at most most_rows
    if not got.num_rows:
        return None
    x, n_words, tokens = ([np.frombuffer(b, t) for b in got.column(c).to_pylist()] for c, t in (("x", "<f4"), ("n", "<i8"), ("tokens", "<u2")))
    bags = Bags(np.repeat(np.arange(len(n_words)), [len(n) for n in n_words]), np.concatenate(x).reshape(-1, N_FEATURES).astype(float), np.concatenate(n_words), np.concatenate(tokens).reshape(-1, 2))
    model = Attention(bags.x.mean(0), bags.x.std(0) + 0.02).fit(bags, got.column("y").to_numpy())
    del bags, x, n_words, tokens
    W.give_back()
    return model


def score(docs: DataFrame, model: Attention | None, text_col: str = "text") -> DataFrame:
    """(row, score): every row as a struct of its columns; without a model every score is 1.

    Workers get the texts alone and return the scores; rows wait in the JVM.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = W.slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", 1 << 20)
            out = [np.ones(part.num_rows) if model is None else model.score(Bags(*passages(W.split(part.column("text"))))) for part in parts]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))
        W.give_back()

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return rows.select("row", F.arrow_udf(run, "double")("text").alias("score"))


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Every passage of a text is encoded; attention weights, learned from document labels, make one
    vector of them, which is scored.  Only texts enter a score.  Passages come from whole texts.

    Null or empty texts are one empty passage and get that passage's score.  Equal texts score
    alike, rows that repeat an id are scored each by itself, and a null id counts as not held out.
    Without labels every score is 1.  An empty table gives an empty result; other columns are
    ignored.
    """
    model = train(docs, labels, id_col, text_col, most_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    out = score(rows, model)
    return out.select("row.doc_id", "row.held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
