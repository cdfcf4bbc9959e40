"""Each operator against brute force on small, awkward tables."""

import os
import sys
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [os.path.dirname(__file__)]
import brute  # noqa: E402

from keystrata.llm import bpe, exact_dedup, license_scan, line_dedup, lm_scoring, mixing, ngram_jaccard, quality_classifier, quality_rules, substring_dedup, words  # noqa: E402
from keystrata.session import checkpoint_dir  # noqa: E402

P = " ".join(f"w{i}" for i in range(40))
DOCS = [
    (1, P + "\nThe same long line\n  the SAME long line \nend"), (2, "x " + P + " y\nthe same long line\nend"), (3, None), (4, ""), (5, P), (6, P), (7, "  " + P.replace(" ", "\t\n") + " "),
    (8, "Ünï cödé " * 30 + " x"), (9, "one two"), (10, "One two"), (11, " \n\n "), (12, " ".join(f"w{i}" for i in range(39)) + " tail"), (13, "long " * 3000 + P),
    (14, "Licensed under the Apache License, Version 2.0.\nunder THE mit license; CC-BY-NC"), (15, "a\r\nb\x1cc 'd don't 12 345 <|endoftext|> 😀 " * 9), (2**40, P),
    (17, "newer \U0001fae9 signs \u1c89x, \U00010d5512 it's\n\n  aaaaaaaa abababab"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, ["en", None][d % 2], f"s{d % 3}" if d % 5 else None, len(t or "")) for d, t in DOCS]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({"g": F.lit(1), "tag": F.lit("x"), "key": F.lit(2), "pos": F.lit(3), "n": F.lit(4)}).repartition(3)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_substring(docs):
    out = substring_dedup.substring_dedup(docs)
    assert rows(out, "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)) == brute.substring(DOCS)


def test_lines(docs):
    out = line_dedup.apply_line_dedup(docs)
    assert rows(out, "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256)) == brute.lines(DOCS)


def test_rules(docs):
    out = quality_rules.quality_rules(docs)
    got = rows(out, "doc_id", *quality_rules.COUNTS, "base_failed")
    assert got == brute.rules(DOCS)
    assert not [r for r in out.collect() if r.base_failed and r.kept]


def test_license(docs):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert got[14].base_labels == "apache-2,cc-by-nc,mit" and got[14].n_base == 3 and (got[14].first_word, got[14].last_word) == (3, 12) and got[14].score == 1
    assert got[3].n_words == 0 and got[3].labels == "" and got[3].first_word is None and len(got) == len(DOCS)


def test_exact(docs):
    assert rows(exact_dedup.exact_dedup(docs, least=8, most=64), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact(DOCS)


def test_exact_with_clashing_hashes(docs):
    """Chunks whose hashes clash are told apart by rank; groups of any size, and very long texts."""
    import random

    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh .\n世界語文") for _ in range(300_000))
    extra = docs.sparkSession.createDataFrame([(70, long), (71, long.replace("\n", "\t ")), (72, long + "x"), (73, "q" * 50_000)], "doc_id long, text string")
    table = DOCS + [tuple(r) for r in extra.collect()]
    both = docs.select("doc_id", "text").union(extra)
    for hash_of in (F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(5))):
        out = exact_dedup.exact_dedup(both, least=8, most=64, hash_of=hash_of)
        assert rows(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact(table)


def test_jaccard(docs):
    assert rows(ngram_jaccard.ngram_jaccard(docs), "doc_id", "n_shingles", "component_id") == brute.jaccard(DOCS)


def test_bpe_round_trip(docs):
    import public_tokenizers as T

    path = T.path(bpe.RANKS)
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path, T.PATTERN, held=50), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    assert rows(out, "doc_id", F.size("ids"), F.sha2(joined, 256), F.sha2("decoded", 256)) == brute.bpe(DOCS)


def test_bpe_awkward_words(spark):
    """Words around the fold's limit, very long ones, and a table that begins anew with every batch."""
    import random

    import public_tokenizers as T

    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("aaabehinorst") for _ in range(n))
    table = [(i, some(n)) for i, n in enumerate((510, 511, 512, 513, 600, 5_000, 200_000))] + [(20, "世界" * 3000), (21, "a" * 3001), (22, None), (23, ""), (24, some(40) + " " + some(700))]
    table += [(100 + i, " ".join(some(rng.randint(1, 9)) for _ in range(200))) for i in range(60)]
    frame = spark.createDataFrame(table + table[:2], "doc_id long, text string").repartition(2)
    path = T.path(bpe.RANKS)
    for held in (20, 1 << 20):
        out = bpe.decode(bpe.encode(frame, path, T.PATTERN, held=held), path)
        joined = F.array_join(F.col("ids").cast("array<string>"), ",")
        assert rows(out, "doc_id", F.size("ids"), F.sha2(joined, 256), F.sha2("decoded", 256)) == brute.bpe(table + table[:2])
    assert bpe.encode(frame.limit(0), path, T.PATTERN).count() == 0


def test_bpe_plan_is_short(docs):
    """The driver writes plans as text and keeps some; the table of ranks must not be in them."""
    import public_tokenizers as T

    out = bpe.encode(docs.select("doc_id", "text"), T.path(bpe.RANKS), T.PATTERN)
    assert len(out._jdf.queryExecution().toString()) < 100_000


@pytest.mark.parametrize("row_pieces", [1, 3, 32])
def test_bpe_rows_of_any_size(docs, row_pieces):
    import public_tokenizers as T

    path = T.path(bpe.RANKS)
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path, T.PATTERN, held=50, row_pieces=row_pieces), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    assert rows(out, "doc_id", F.size("ids"), F.sha2(joined, 256), F.sha2("decoded", 256)) == brute.bpe(DOCS)


def _merged(pieces, ranks):
    """Ids of a word that is cut into ``pieces``, by the definition."""
    while True:
        r, i = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))), default=(1 << 30, 0))
        if r == 1 << 30:
            return [ranks[x] for x in pieces]
        pieces = [*pieces[:i], pieces[i] + pieces[i + 1], *pieces[i + 2 :]]


def test_bpe_begins_with_sure_pairs():
    """Words go to the fold with the pairs merged that merge in any case; vocabularies of any order of ranks keep their ids."""
    import random

    import pyarrow as pa
    import public_tokenizers as T

    rng = random.Random(3)
    letters = b"abcd"
    found = 0
    for _ in range(60):
        longer = list({bytes(rng.choices(letters, k=rng.choice([2, 2, 2, 3, 4]))) for _ in range(rng.randint(2, 14))})
        rng.shuffle(longer)
        ranks = {t: i for i, t in enumerate([bytes([i]) for i in range(256)] + longer)}
        sure = bpe.SurePairs(ranks)
        words_ = [bytes(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(50)]
        size = np.array([len(w) for w in words_])
        begin = sure.begin(np.frombuffer(b"".join(words_), np.uint8), np.cumsum(size) - size)
        for w, b in zip(words_, np.split(begin, np.cumsum(size)[:-1])):
            cut = [w[i : i + 2] if b[i] else w[i : i + 1] for i in range(len(w)) if not (i and b[i - 1])]
            assert b"".join(cut) == w and _merged(cut, ranks) == _merged([w[i : i + 1] for i in range(len(w))], ranks)
        found += int(begin.sum())
    assert found > 100
    ranks = bpe.load_ranks(T.path(bpe.RANKS))
    speller = bpe._Speller(ranks, T.PATTERN, pa.schema([pa.field("_codes", pa.binary()), pa.field("_anew", pa.bool_()), pa.field("_parts", pa.list_(pa.list_(pa.int32())))]), 99)
    byte_of = {i: t for t, i in ranks.items()}
    for w in (b" the", b"x"):
        (got,) = speller.spelt(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), False)
        parts = got.column(2).to_pylist()[0][0]
        assert b"".join(byte_of[i] for i in parts) == w and len(parts) < max(2, len(w))


def test_workers_rest(monkeypatch):
    """A worker gives memory back in the middle of a task, when the batch before is dropped."""
    seen, alive = [], []
    monkeypatch.setattr(words, "give_back", lambda: seen.append((len(alive), alive[-1]() is None)))

    class Batch:
        pass

    def made(_):
        batch = Batch()
        alive.append(weakref.ref(batch))
        return batch

    for batch in words.rests(map(made, range(7)), lambda b: 10, 30):
        del batch
    assert seen == [(3, True), (6, True)]


def _resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20


def test_room_is_not_written_before_it_is_used():
    """Room for more is pages that nobody has touched, so it costs no memory."""
    a = np.ones(1 << 23, np.int32)
    before = _resident_mb()
    b = bpe._room(a, len(a) + 1)
    assert len(b) == 2 * len(a) and (b[: len(a)] == 1).all() and not b[len(a) : len(a) + 9].any()
    assert _resident_mb() - before < 48  # 32 MB of the copy; it was 64


def test_mixing(docs):
    out = mixing.mix(docs).toPandas()
    per = out.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (out.taken <= 2 * out["size"]).all() and abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6
    assert ((per.taken - per.target).abs() <= 1).all() and (per.target <= 2 * per["size"]).all()


def test_mixing_against_brute_force(spark, docs):
    import random

    rng = random.Random(13)
    made = [(i, "w " * rng.choice([0, 1, 5, 40, 3000]) or None, rng.choice(["a", "b", "c", "d", "d", "d", None])) for i in range(300)]
    for table in (made, [(d, t, f"s{d % 3}" if d % 5 else None) for d, t in DOCS], [(1, "x y", "only")]):
        frame = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(3)
        got = rows(mixing.mix(frame), "doc_id", "size", "source_size", "target", "taken")
        assert [(*g[:3], round(g[3], 6), g[4]) for g in got] == [(*w[:3], round(w[3], 6), w[4]) for w in brute.mix(table)]
    got = mixing.mix(spark.createDataFrame(made, "doc_id long, text string, source string"), share=(3, 1))
    assert got.where("taken <> 2 * size or target <> 2 * source_size").count() == 0
    twice = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (1, "a", "s")], "doc_id long, text string, source string")
    assert mixing.mix(twice).agg(F.sum("taken")).first()[0] == 11 and mixing.mix(twice).count() == 3


def test_lines_awkward(spark):
    """Repeated rows, hot lines over many partitions, bitmaps over batches, and a very long text."""
    line = "this line stands in very many documents"
    table = [(d, "\n".join([line, f"own line of document {d}", line.upper() + " \t"] * (1 + d % 3))) for d in range(400)]
    table += [(500, "\n".join(f"line number {i}" for i in range(30_000))), (501, "\n".join(f"LINE number {i}" for i in range(0, 60_000, 2))), (502, None), (502, None)] + table[5:8] * 3
    frame = spark.createDataFrame(table, "doc_id long, text string").withColumns({"_id": F.lit(1), "_tag": F.lit("x"), "_n": F.lit(2), "_keep": F.lit(3)}).repartition(7)
    out = line_dedup.apply_line_dedup(frame)
    assert rows(out, "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256)) == brute.lines(table)
    assert {"_id", "_tag", "_n", "_keep"} <= set(out.columns)


def _to_python(df):
    """Lines of the plan that hand rows to Python workers."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "InArrow" in x or "EvalPython" in x]


def test_texts_stay_in_the_jvm(spark, docs):
    """A batch of texts takes several times its size on both sides: lines sends none, and a score's batch holds each text once."""
    assert not [x for x in _to_python(line_dedup.apply_line_dedup(docs)) if "text" in x]
    plan = _to_python(quality_classifier.score(docs, None))
    assert len(plan) == 1 and "ArrowEvalPython [run(text#" in plan[0]


def test_lines_around_the_last_bit(spark):
    """Drops at any place of a bitmap, lines behind its last byte, and empty lines at the end."""
    own = [(d, "\n".join(f"own line {d} of this text {i}" for i in range(20))) for d in range(1, 22)]
    table = [(0, "\n".join(f"common line {i} of all texts" for i in range(40)))]
    table += [(d, "\n".join([f"common line {i} of all texts" if i % d == 0 or i == d else x for i, x in enumerate(t.split("\n"))] + [""] * (d % 3))) for d, t in own]
    out = line_dedup.apply_line_dedup(spark.createDataFrame(table, "doc_id long, text string"))
    assert rows(out, "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256)) == brute.lines(table)


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() over a whole table, with clashing columns; the classifier's own verdicts say what the first stage keeps."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    more = docs.withColumns({"_id": F.lit(1), "_tag": F.lit("t"), "_times": F.lit(2), "_stays": F.lit(3), "_score": F.lit(4), "row": F.lit(5), "id": F.lit(6), "mark": F.lit(7)})
    more.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in quality_classifier.quality_classifier(docs, labels).where("predicted = 1").collect()}
    want = brute.pipeline([(r.doc_id, r.text, r.source) for r in docs.collect()], kept)
    got = sorted((r.doc_id, r.source, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert 0 < len(kept) < docs.count() and got == want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert out.columns == more.columns and out.count() > 0, name
        assert stage(spark, more.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_line_dedup", "op6_mixing", "op9_exact_dedup"])
def test_query_matches_sql(spark, name):
    import duckdb

    from keystrata.llm import queries

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    cur = con.execute(queries.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(cur.fetchall())


def test_classifier_and_lm(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 15)], "doc_id long, quality int, toxic int")
    out = quality_classifier.quality_classifier(docs, labels).toPandas()
    assert len(out) == len(DOCS) and out.score.between(0, 1).all()
    assert quality_classifier.quality_classifier(docs, labels.limit(0)).where("predicted <> 1").count() == 0
    lm = lm_scoring.lm_scoring(docs, labels.where("quality = 1").select("doc_id")).toPandas().set_index("doc_id")
    assert len(lm) == len(DOCS) and lm.loc[4].n_tokens == 0 and lm.difference.notna().sum() == (lm.n_tokens > 0).sum()


def test_classifier_learns_words(spark):
    """Junk that no byte class tells: the same letters, other words; in long texts a few passages decide."""
    import random

    rng = random.Random(6)
    letters = "abcdefghij"
    word = lambda: "".join(rng.choice(letters) for _ in range(5))
    good, bad = [word() for _ in range(300)], [word() for _ in range(300)]
    table = []
    for d in range(600):
        y = d % 2
        text = [rng.choice(good if y or rng.random() < 0.6 else bad) for _ in range(rng.randint(60, 500))]
        table.append((d, " ".join(text), y, f"x{d}"))
    frame = spark.createDataFrame(table, "doc_id long, text string, quality int, _score string")
    out = quality_classifier.quality_classifier(frame.drop("quality"), frame.select("doc_id", "quality")).toPandas().set_index("doc_id")
    held = out[out.held_out]
    one, none = ([held.score[d] for d in held.index if d % 2 == k] for k in (1, 0))
    assert sum(a > b for a in one for b in none) / (len(one) * len(none)) > 0.95
    again = quality_classifier.quality_classifier(frame.repartition(7).union(frame.limit(3)), frame.select("doc_id", "quality")).toPandas()
    assert len(again) == 603 and (abs(again.groupby("doc_id").score.max() - out.score) < 1e-9).all()
    assert quality_classifier.quality_classifier(frame.limit(0), frame.select("doc_id", "quality")).count() == 0
    long = spark.createDataFrame([(1, "a" * 3_000_000), (2, "A" * 2_200_000 + " b")], "doc_id long, text string").toArrow()
    x = quality_classifier.passages(quality_classifier.W.split(long.column("text")))[1]
    assert abs(x[0, 1] - 1) < 1e-6 and abs(x[1, 0] - 1) < 1e-5


def test_empty_tables(docs):
    none = docs.limit(0)
    for f in (substring_dedup.substring_dedup, line_dedup.apply_line_dedup, quality_rules.quality_rules, license_scan.license_scan, exact_dedup.exact_dedup, ngram_jaccard.ngram_jaccard, mixing.mix):
        assert f(none).count() == 0


def test_repeated_rows(docs):
    twice = docs.union(docs)
    again = DOCS + DOCS
    assert rows(substring_dedup.substring_dedup(twice), "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)) == brute.substring(again)
    assert rows(ngram_jaccard.ngram_jaccard(twice), "doc_id", "n_shingles", "component_id") == brute.jaccard(again)
    assert exact_dedup.exact_dedup(twice).where("kept").count() == exact_dedup.exact_dedup(docs).where("kept").count()


def test_jaccard_near_copies(spark, monkeypatch):
    """A group of near copies around the threshold, over several blocks of a key."""
    import random

    monkeypatch.setattr(ngram_jaccard, "BLOCK_NODES", 8)
    monkeypatch.setattr(ngram_jaccard, "GROUP_ROWS", 64)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    made = []
    for d in range(60):
        words = list(base)
        for at in rng.sample(range(150), 2 + d % 3):
            words[at] = f"x{d}_{at}"
        made.append((d, " ".join(words)))
    frame = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(ngram_jaccard.ngram_jaccard(frame), "doc_id", "n_shingles", "component_id") == brute.jaccard(made)


def test_components_of_a_long_chain(spark):
    checkpoint_dir(spark)
    order = [(5 * k) % 13 for k in range(13)]  # labels fall along no direction of the chain
    links = [*zip(order[:-1], order[1:], strict=True), (200, 201), (201, 201)]
    got = {r.node: r.label for r in ngram_jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(13), 0), 200: 200, 201: 200}


def test_null_ids(spark):
    """Rows without an id are one document after all others; component ids are null where no row has one."""
    import corpus_pipeline

    last = 2**63 - 1
    alone = " ".join(f"q{i}" for i in range(40))
    texts = [(3, P + "\nThe same long line\nend"), (None, "y " + P + "\nthe same long line\nend"), (None, alone + "\nanother long line"), (None, alone + "\nanother long line too"), (last, P), (None, None), (None, "short")]
    frame = spark.createDataFrame([(d, t, f"s{i % 2}") for i, (d, t) in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    named = [(last + 1 if d is None else d, t) for d, t in texts]
    back = lambda got: sorted((last + 1 if r[0] is None else r[0], *r[1:]) for r in got)
    got = substring_dedup.substring_dedup(frame).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert back(got) == brute.substring(named)
    got = line_dedup.apply_line_dedup(frame).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256)).collect()
    assert back(got) == brute.lines(named)
    # one by one: the i-th row without an id has its own number in brute force
    single = [(last + 1 + i if d is None else d, t) for i, (d, t) in enumerate(texts)]
    want = sorted((min(d, last + 1), n, min(c, last + 1)) for d, n, c in brute.jaccard(single))
    assert sorted(tuple(last + 1 if x is None else x for x in r) for r in ngram_jaccard.ngram_jaccard(frame).select("doc_id", "n_shingles", "component_id").collect()) == want
    near = corpus_pipeline.near_duplicates(spark, frame, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in near if r.text not in (alone + "\nanother long line", alone + "\nanother long line too")) == sorted([(0, ""), (0, "short"), (3, texts[0][1])]) and len(near) == 4
    times = {(r.doc_id, r.tag): -(-r.taken // r.size) for r in mixing.mix(frame).collect() if r.taken}
    assert None in {d for d, _ in times} and corpus_pipeline.mixture(spark, frame, "").count() == sum(times.values())


def test_license_repeated_rows(spark):
    """Rows that repeat id and text keep the labels of one such row."""
    row = "mozilla, gnu, cc: redistribution and use in source and binary forms, with or without modification, are permitted"
    common = [(100 + i, "redistribution and use in source and binary forms with or without modification are") for i in range(20)]
    frame = spark.createDataFrame([(1, row), (1, row), *[(None, row)] * 5, *common], "doc_id long, text string")
    got = [r.labels for r in license_scan.license_scan(frame).where("doc_id is null or doc_id = 1").collect()]
    assert got == ["bsd-3"] * 7


def test_license_over_line_breaks(spark):
    """Labels and score don't depend on where a notice is wrapped; words far apart are no notice."""
    made, want = [], {}
    for k, (label, text) in enumerate(license_scan.TEMPLATES):
        w = text.split()
        far = [x + " and more words of prose between the words" * 3 for x in w if x not in ("and", "of", "the")]
        for d, shown in ((k, " ".join(w)), (k + 100, "\n".join(w)), (k + 200, "a b\n # " + " ".join(w[: len(w) // 2]) + "\n\n # " + " ".join(w[len(w) // 2 :]).upper() + "\nc d")):
            made.append((d, shown))
            want[d] = label
        made.append((k + 300, "\n".join(far)))
    frame = spark.createDataFrame([*made, (400, "terms of the Mozilla Public\nLicense, v. 2.0"), (401, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(frame).collect()}
    assert all(want[d] in got[d].labels.split(",") and got[d].score == 1 for d in want)
    assert all(got[k + 100].labels == got[k + 200].labels == got[k].labels for k in range(7))
    assert all(got[k + 300].labels == "" for k in range(7)) and got[400].labels == "" and got[401].labels == "bsd-3"


def test_rules_planted_outliers(spark):
    """Very short words don't make up for junk: letter-spaced text goes, and so does text half of symbols."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 9)))
    clean = [(i, " ".join(word() for _ in range(rng.randint(80, 200))) + ".") for i in range(300)]
    letters = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    symbols = " ".join(rng.choice("#*$%&|<>") if i % 2 else rng.choice("abcdefghijklmnopqrstuvwxyz") for i in range(120))
    frame = spark.createDataFrame([*clean, (1000, letters), (1001, symbols)], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web")})
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame).collect()}
    assert not any(got[d].base_failed or got[d].kept for d in (1000, 1001)) and all(got[d].kept for d, _ in clean)


def test_rules_small_groups(spark):
    """A group of a few rows is judged by its own estimate, drawn to its language's; nulls are groups too."""
    import random

    rng = random.Random(8)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(a, b)))
    text = lambda n, a=3, b=9: " ".join(word(a, b) for _ in range(n)) + "."
    table = [(i, text(rng.randint(80, 200)), ["en", "de", None][i % 3], f"s{i % 7}" if i % 5 else None) for i in range(500)]
    table += [(900 + i, text(90, 1, 1), "en", f"t{i}") for i in range(2)] + [(950, text(90), "xx", "only"), (None, text(100), "en", "s1")]
    frame = spark.createDataFrame(table + table[:3], "doc_id long, text string, lang string, source string").repartition(5)
    got = quality_rules.quality_rules(frame).collect()
    assert len(got) == len(table) + 3 and len({r.key for r in got}) == len({(t[2], t[3]) for t in table})
    assert {r.doc_id for r in got if not r.kept} == {900, 901}


def test_minimum_covariance_against_numpy(spark):
    """One group: the estimate equals concentration steps done by hand."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, 6)) @ rng.normal(0, 1, (6, 6)), rng.normal(9, 1, (40, 6))])
    frame = spark.createDataFrame([("g", None, r.tolist()) for r in x], "key string, parent string, x array<double>")
    got = quality_rules.minimum_covariance(frame).first()
    floor = np.diag(quality_rules.FLOOR**2)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    m, c = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2)
    for _ in range(quality_rules.STEPS):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + floor), x - m)
        core = x[d <= np.quantile(d, quality_rules.CORE, method="inverted_cdf")]
        m, c = core.mean(0), np.cov(core.T, bias=True)
    assert np.allclose(got.centre, m, atol=1e-6) and np.allclose(np.array(got.cov).reshape(6, 6), c, atol=1e-6)


def test_license_base_columns(spark, docs):
    more = [(50, "Under\n the MIT, license. under the mit licenses; UNDER THE MIT LICENSE"), (51, "apache--license (version) 2 and 20; cc BY-NC cc by ncé"), (52, "under the the mit license"), (53, "x\ncc\nby\nnc")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    place = lambda c: F.coalesce(c, F.lit(-1))
    got = rows(license_scan.license_scan(both), "doc_id", "n_words", "n_base", place("first_word"), place("last_word"), "base_labels")
    assert got == brute.licenses(DOCS + more)


def test_lm_against_brute_force(spark, docs):
    """Every loss, with the exact count of distinct words, repeated ids and an id that most rows repeat."""
    import random

    rng = random.Random(11)
    made = [(i, " ".join(rng.choice(["the", "cat", "Sat", "on", f"w{rng.randrange(40)}"]) for _ in range(30))) for i in range(25)]
    for table, target in ((DOCS, {1, 2, 5, 17}), (made, {1, 3, 24}), (made, set()), ([(1, "a b"), (2, None), (3, "c")], {1})):
        ids = spark.createDataFrame([(i,) for i in sorted(target)] + [(None,), (999,)], "doc_id long")
        frame = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
        got = sorted(tuple(r)[:4] for r in lm_scoring.lm_scoring(frame, ids).collect())
        want = brute.lm(table, target)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(w[k] is None and g[k] is None or abs(g[k] - w[k]) < 1e-9 for g, w in zip(got, want, strict=True) for k in (2, 3))
    many = spark.createDataFrame([(7, f"x y z{i % 50}") for i in range(3000)] + [(8, "x y")], "doc_id long, text string")
    got = lm_scoring.lm_scoring(many, spark.createDataFrame([(7,)], "doc_id long"))
    assert got.count() == 3001 and got.where("n_tokens = 3").select("difference").distinct().count() <= 50


def test_requests_cost_their_keys():
    """Window requests don't grow with the number of buckets beyond their keys."""
    import pyarrow as pa

    text = [" ".join(f"{d}_{i}" for i in range(40)) for d in range(1250)]
    group = pa.table({"doc_id": pa.array(range(0, 1250 * 200, 200), pa.int64()), "text": text})
    size = {b: sum(len(x) for _, x in substring_dedup._request(group, 13, b)) for b in (136, 8000)}
    assert size[8000] < 1.5 * size[136] + 8000 * 45


def test_packed_keys():
    import numpy as np

    from keystrata.llm import exchange

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 5000):
        key = np.unique(np.concatenate([rng.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True), np.array([0, 2**64 - 1, 5][:n], np.uint64)]))
        assert (exchange.unpack_sorted(exchange.pack_sorted(key)) == key).all()
        assert (np.diff(exchange.bucket_of(key, 136)) >= 0).all() and (not n or exchange.bucket_of(key, 136).max() < 136)


def test_short_texts_only(spark):
    """No text has a window, a bigram or a partner."""
    table = [(1, "a"), (2, "b"), (3, "")]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    assert rows(substring_dedup.substring_dedup(frame), "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)) == brute.substring(table)
    assert rows(ngram_jaccard.ngram_jaccard(frame), "doc_id", "n_shingles", "component_id") == brute.jaccard(table)


def test_license_templates_against_brute_force(spark):
    """Templates whole, wrapped, cut and with words lost, near the threshold; the longest text has 40,000 words."""
    import random

    rng = random.Random(4)
    made = [(None, None), (-1, "")]
    for k, (_, text) in enumerate(license_scan.TEMPLATES):
        w = text.split()
        for j, lost in enumerate((0, 0.15, 0.2, 0.25, 0.4)):
            kept = [x if rng.random() >= lost else "lorem" for x in w]
            sep = [" ", "\n", ", "][j % 3]
            made.append((k * 10 + j, "the of Intro\n" + sep.join(kept).title() + "\nand more"))
    filler = " ".join(rng.choice(["the", "of", "copy", "lorem", "ipsum", "license"]) for _ in range(40_000))
    made += [(1000, filler), (1001, filler + " " + license_scan.TEMPLATES[7][1]), (1002, "\n".join([license_scan.TEMPLATES[1][1]] * 3))]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    base = lambda t: brute.licenses([(0, t)])[0]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(frame).collect()}
    for d, labels, best in brute.template_labels([(d if d is not None else -2, t) for d, t in made], license_scan.TEMPLATES):
        named = base(dict(made).get(d if d != -2 else None))
        want = ",".join(sorted({x for x in (labels + "," + named[5]).split(",") if x}))
        assert got[d if d != -2 else None] == (want, 1.0 if named[2] else best)
