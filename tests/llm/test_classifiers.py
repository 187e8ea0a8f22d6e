import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from ledgerwake.llm import language_id, quality_classifier
from ledgerwake.llm.common import crc_mod


def test_language_of_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs.filter(crc_mod(F.col("doc_id"), 4) != 2))
    own = docs.filter((crc_mod(F.col("doc_id"), 4) == 2) & F.col("lang").isNotNull()).select("lang", language_id.predict_column(F.col("text"), model, spark).alias("p")).collect()
    known = [r for r in own if r.p.lang != "und"]
    assert sum(r.lang == r.p.lang for r in known) >= 0.9 * len(known) > 0
    odd = spark.createDataFrame([(None,), ("",), ("123 !",), ("the " * 100_000,)], "text string").select(language_id.predict_column(F.col("text"), model, spark).alias("p")).collect()
    assert [r.p.lang for r in odd[:3]] == ["und"] * 3 and [r.p.score for r in odd[:3]] == [0.0] * 3 and 0 < odd[3].p.score <= 1


def test_codewords_differ():
    for n in (2, 4, 7, 12, 40):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code}) == n and (np.abs(code.sum(axis=0)) < n).all()


def test_language_without_labels(docs_of, spark):
    model = language_id.fit(docs_of(["x y"]).withColumn("lang", F.lit(None).cast("string")))
    assert model.predict(["x y", None])[0] == ["und", "und"]


def test_ordinal_thresholds_and_weights():
    draw = np.random.default_rng(0)
    there = draw.random((3000, 6)) < 0.4
    level = there @ np.array([3.0, -3.0, 0, 0, 0, 0]) + draw.logistic(size=3000)
    grades = np.digitize(level, [-1.0, 1.0])
    bucket = np.nonzero(there)[1].astype(np.int32)
    model = quality_classifier.fit_ordinal(bucket, np.ones(len(bucket), np.float32), there.sum(axis=1), grades, 3)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    assert abs(weight[0] - 3) < 0.5 and abs(weight[1] + 3) < 0.5 and not set(weight) - {0, 1}
    assert np.allclose(model.thresholds, [-1, 1], atol=0.4)
    assert np.allclose(model.chances(np.array([0.0, 50.0])).sum(axis=1), 1)


def test_select_good(docs_of, spark):
    texts = ["fine words here", "vile words here"] * 60 + [None, "", "fine " * 50_000]
    docs = docs_of(texts).withColumn("_chances", F.lit("clash"))
    ratings = docs.filter("doc_id < 120").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 2).otherwise(0).alias("grade"))
    kept = quality_classifier.select_good(docs, ratings, least_chance=0.5)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and ids & set(range(120)) == set(range(0, 120, 2))
    assert quality_classifier.select_good(docs, ratings.limit(0)).count() == len(texts)


def test_repeated_rows_and_ratings_count_once(docs_of, spark):
    texts = ["fine words here", "vile words here"] * 60
    docs = docs_of(texts)
    ratings = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 2).otherwise(0).alias("grade"))
    many = F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") == 1, 500).otherwise(1)))
    once, cut = quality_classifier.fit(docs, ratings)
    again, same_cut = quality_classifier.fit(docs.withColumn("n", many), ratings.withColumn("n", many))
    assert np.array_equal(once.buckets, again.buckets) and np.array_equal(once.weights, again.weights) and np.array_equal(once.thresholds, again.thresholds)
    assert cut == same_cut and len(once.buckets)


def test_starts_of_words():
    extract, n = quality_classifier.Features(), 6
    value = dict(zip(*map(np.ndarray.tolist, extract("vilefully vileful, vile fine Vileful-ness x"))))
    assert np.isclose(value[quality_classifier._bucket("start", "vilef")], quality_classifier.SHARE * np.sqrt(3 / n))
    assert quality_classifier._bucket("start", "vile") not in value and quality_classifier._bucket("start", "fine") not in value


def test_words_that_share_a_stem_are_told_apart(docs_of):
    texts = [f"{'vilet' if k % 4 == 1 else 'finer'}{chr(97 + k % 26)}{chr(97 + k // 26)} and words of its own w{k % 7}" for k in range(400)]
    docs = docs_of(texts)
    ratings = docs.filter("doc_id < 200").select("doc_id", F.when(F.col("doc_id") % 4 == 1, 0).otherwise(2).alias("grade"))
    assert {r.doc_id for r in quality_classifier.select_good(docs, ratings).collect()} == {k for k in range(400) if k % 4 != 1}


def test_select_good_with_few_or_wrong_ratings(docs_of):
    for n, wrong in ((80, {5}), (80, set()), (1000, set(range(1, 1000, 100)))):  # of which every fourth is vile
        docs = docs_of([f"{'vile' if k % 4 == 1 else 'fine'} words w{k % 7} here" for k in range(n)])
        vile = F.col("doc_id") % 4 == 1
        flipped = F.col("doc_id").isin(*wrong) if wrong else F.lit(False)
        ratings = docs.select("doc_id", F.when(vile == flipped, 2).otherwise(0).alias("grade"))
        kept = {r.doc_id for r in quality_classifier.select_good(docs, ratings).collect()}
        assert kept == {k for k in range(n) if k % 4 != 1}, (n, len(kept))


def test_best_cut():
    good = np.arange(100) % 4 > 0
    assert 0.5 <= quality_classifier.best_cut(np.where(good, 0.95, 0.02), good) <= 0.85
    odd = np.where(good, 0.95, 0.02)
    odd[1] = 0.01
    assert 0.5 <= quality_classifier.best_cut(odd, good) <= 0.85
    assert quality_classifier.best_cut(np.full(100, 0.7), good) == 0.75
    assert np.isclose(quality_classifier.best_cut(np.where(~good, 0.95, 0.02), ~good), 0.25)


def test_every_language_is_learned(docs_of):
    names = [f"l{k:03}" for k in range(230)]
    texts = [f"{chr(0x4E00 + 2 * k)}{chr(0x4E01 + 2 * k)} " * 20 for k in range(230)]
    model = language_id.fit(docs_of(texts * 2, lang=names * 2), per_language=2, most_rows=300)
    assert model.languages == names and model.predict(texts)[0] == names


def test_decoding_is_the_loss_weighted_nearest_codeword(spark):
    draw = np.random.default_rng(1)
    code, trust = language_id.codewords(5), draw.random((5, 15))
    model = language_id.LanguageModel(list("abcde"), code, draw.normal(size=(language_id.N_BUCKETS, 15)).astype(np.float32), np.zeros(15, np.float32), trust)
    texts = ["some words", "Other words", "été", "x" * 500]
    bits = language_id.shares(language_id.ngram_counts(texts)) @ model.weights
    for k, (name, score) in enumerate(zip(*model.predict(texts)[:2])):
        loss = [sum(t * np.log1p(np.exp(-z * c)) for z, c, t in zip(bits[k], row, own)) for row, own in zip(code, trust)]
        assert name == "abcde"[int(np.argmin(loss))] and np.isclose(score, 1 / sum(np.exp(min(loss) - x) for x in loss), rtol=1e-4)


def test_many_short_texts_take_little_memory():
    run = """
import resource, sys
import pandas as pd
from ledgerwake.llm import common, language_id
texts = ["sixteen letters x"] * 10_000
for own in common.in_slices(texts, language_id.SLICE, language_id.ROWS):
    language_id.ngram_counts(own)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, check=True).stdout) < 500


def test_grade_chances_are_the_cumulative_model(spark):
    extract, texts = quality_classifier.Features(), ["fine words", "", None, "Some other WORDS here 123"]
    buckets = np.unique(np.concatenate([extract(x)[0] for x in texts]))
    model = quality_classifier.OrdinalModel(buckets, np.linspace(-1, 1, len(buckets)).astype(np.float32), np.array([-0.5, 1.0]))
    weight = dict(zip(buckets.tolist(), model.weights.tolist()))
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = {r.k: r.g for r in frame.select("k", quality_classifier.grade_chances(F.col("text"), model, spark).alias("g")).collect()}
    for k, x in enumerate(texts):
        level = sum(weight[b] * v for b, v in zip(*map(np.ndarray.tolist, extract(x))))
        tail = [1 - 1 / (1 + np.exp(level - t)) for t in model.thresholds]
        assert np.allclose(rows[k].tail, tail, atol=1e-5) and np.isclose(rows[k].expected_grade, sum(tail), atol=1e-5)


def test_learning_from_long_texts_is_bounded_in_characters(docs_of):
    """64 texts of a million characters: a process of its own stays under 500 MB over the texts' slices, and a model is learned from such rows."""
    run = """
from ledgerwake.llm.common import in_slices
from ledgerwake.llm.language_id import ROWS, SLICE, ngram_counts
text = "some words of a long text " * 38_462
total = sum(int(ngram_counts(own).sum()) for own in in_slices([text] * 64, SLICE, ROWS))
assert total > 64_000_000
print(next(int(x.split()[1]) // 1024 for x in open("/proc/self/status") if x.startswith("VmHWM")))
"""
    done = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
    assert done.returncode == 0 and int(done.stdout.split()[-1]) < 500, done.stdout + done.stderr
    texts = ["the house and the garden " * 8000, "das haus und der garten " * 8000] * 8
    model = language_id.fit(docs_of(texts, lang=["en", "de"] * 8))
    assert model.predict(["the garden and a house", "der garten und ein haus"])[0] == ["en", "de"]


def test_sample_is_bounded_in_rows_and_entries(docs_of, spark):
    """Neither long texts nor an id with many texts make the sample larger; within the bounds every rated text is in it."""
    long = docs_of([" ".join(f"a{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300)) for k in range(200)])
    ratings = long.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
    size = lambda rows: rows.agg(F.count(F.lit(1)), F.sum(F.size("bucket"))).first()
    n, entries = size(quality_classifier.sample(long, ratings))
    assert n == 200 and entries > 200 * 300
    n, entries = size(quality_classifier.sample(long, ratings, most_entries=20_000))
    assert 0 < n < 200 and 10_000 < entries < 30_000
    many = docs_of([f"text number {k}" for k in range(300)]).withColumn("doc_id", F.lit(7).cast("long"))
    one = spark.createDataFrame([(7, 2)], "doc_id long, grade int")
    assert quality_classifier.sample(many, one).count() == 300 and 20 < quality_classifier.sample(many, one, most_rows=50).count() < 90
    assert quality_classifier.sample(many.limit(0), one).count() == 0


def test_select_good_with_null_ids_and_clashing_names(docs_of):
    docs = docs_of([f"{'vile' if k % 4 == 1 else 'fine'} words w{k % 7} here" for k in range(200)])
    ratings = docs.filter("doc_id < 120").select("doc_id", F.when(F.col("doc_id") % 4 == 1, 0).otherwise(2).alias("grade"))
    docs = docs.withColumns({c: F.lit("clash") for c in ("grade", "key", "bucket", "value", "id_hash", "_rated_id", "_doc_id")})
    docs = docs.withColumns({"place": F.col("doc_id"), "doc_id": F.when(F.col("doc_id") < 160, F.col("doc_id"))})
    kept = quality_classifier.select_good(docs, ratings.unionByName(ratings.selectExpr("CAST(null AS long) AS doc_id", "2 AS grade")))
    assert kept.columns == docs.columns and sorted(r.place for r in kept.collect()) == [k for k in range(200) if k % 4 != 1]
