import hashlib
import math
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerwake.llm import fingerprint, mixing


def test_fingerprints(docs_of):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join(words), " ".join(words[:300] + ["new"] + words[300:]), " ".join(f"v{k}" for k in range(400)), None, "", "one two", "x " * 5000]
    docs = docs_of(texts).withColumn("fp", fingerprint.fingerprint(F.col("text")))
    fp = {r.doc_id: r.fp for r in docs.collect()}
    assert fp[0] == fp[1] and fp[4] == fp[5] == [] and all(len(fp[k]) == fingerprint.N_BINS for k in (0, 2, 3, 6, 7))
    pairs = docs.select(F.col("doc_id").alias("a"), F.col("fp").alias("x")).join(docs.select(F.col("doc_id").alias("b"), F.col("fp").alias("y"))).select("a", "b", fingerprint.likeness(F.col("x"), F.col("y")).alias("l"))
    like = {(r.a, r.b): r.l for r in pairs.collect()}
    assert like[0, 1] == 1 and like[4, 5] == 1 and like[4, 0] == 0 and like[0, 3] < 0.1
    assert abs(like[0, 2] - 392 / 401) < 0.12


def test_next_row_by_falling_id(docs_of):
    docs = docs_of(["a", "b", "c", "d", "e"]).withColumn("_range", F.lit("clash"))
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, ["text"], rows_each=2).collect()}
    assert got == {4: "d", 3: "c", 2: "b", 1: "a", 0: "e"}
    assert fingerprint.with_next(docs.limit(0), ["text"]).count() == 0


@pytest.mark.parametrize("rows_each, most", [(2, 3), (5, 1 << 14), (1000, 2)])
def test_next_row_among_hot_ids(spark, rows_each, most):
    ids = [7] * 60 + [None] * 40 + list(range(30)) + list(range(1000, 1400, 17)) + [2**60, -5, -5, -5]
    texts = [None if k == 3 else "same" if k > len(ids) - 4 else f"text {k}" for k in range(len(ids))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    tie = lambda x: 42 if x is None else xxhash.xxh64_intdigest(x.encode(), seed=42)
    place = lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]) >> 32, r[1] or "")
    falling = sorted(zip(ids, texts), key=place)
    expected = Counter((*a, b[1]) for a, b in zip(falling, falling[1:] + falling[:1]))
    assert Counter(map(tuple, fingerprint.with_next(docs, ["text"], rows_each=rows_each, most=most).select("doc_id", "text", "next_text").collect())) == expected


def test_ranges_grow_in_number(spark):
    rows = spark.range(0, 30_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 77).when(F.col("id") % 7 > 1, F.col("id") * 5).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    tie = F.shiftrightunsigned(F.xxhash64("text"), 32)
    for most in (16, 1 << 14):  # with few quantiles as with many
        sizes = [r["count"] for r in rows.groupBy(fingerprint._ranges(rows, "doc_id", tie, 100, most).alias("r")).count().collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 300 and len(sizes) > 150


def test_poisson_counts(docs_of):
    source = ["hot"] * 60 + ["cold"] * 20 + [None] * 10 + ["blank"] * 2
    texts = ["x" * 100] * 60 + ["y" * 40] * 20 + ["z"] * 10 + [None, ""]
    docs = docs_of(texts, source=source).withColumn("_mix_cdf", F.lit("clash"))
    chars = Counter()
    for s, t in zip(source, texts):
        chars[s] += len(t or "")
    live = sum(c > 0 for c in chars.values())
    expected = Counter()
    for k, s in enumerate(source):
        rate = sum(chars.values()) / live / chars[s] if chars[s] else 0.0
        u = int(hashlib.md5(f"0:{k}".encode()).hexdigest()[:13], 16) / 2**52
        n, p, below = 0, math.exp(-rate), math.exp(-rate)
        while below <= u:
            n += 1
            p *= rate / n
            below += p
        if n:
            expected[k] = n
    mixed = mixing.mix(docs, copy_col="copy_no")
    assert mixed.columns == [*docs.columns, "copy_no"]
    assert Counter(r.doc_id for r in mixed.collect()) == expected
    assert mixing.mix(docs.limit(0)).count() == 0


def test_large_rates(docs_of):
    docs = docs_of(["x"] * 4).select((F.col("doc_id") * 0.3).alias("u"))
    start = time.time()
    got = [r.n for r in docs.select(mixing.poisson_count(F.lit(1e6), F.col("u")).alias("n")).collect()]
    assert all(abs(n - 1e6) < 5000 for n in got[1:]) and got[1:] == sorted(got[1:]) and time.time() - start < 20


def test_repeated_rows_are_shuffled_apart(spark):
    rows = spark.range(0, 800, 1, 8).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are put together again
    try:
        assert mixing.mix(rows).groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
