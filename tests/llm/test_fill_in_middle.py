import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from ledgerwake.llm import fill_in_middle, queries

MARKS = ("<P>", "<S>", "<M>")
sha256 = lambda x: hashlib.sha256(x.encode()).hexdigest()


def brute(doc_id, text, fim=90, spm=20, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    draw = random.Random(13)
    return [None, "", "a", "<P>", "x <M> y", "<", "ab<", "<<S", "<M", "a\0b", "é\nü 😀!!", "W" * 70_000, "w, " * 60_000] + ["".join(draw.choice("abZ <>PSM\n\r\té😀") for _ in range(draw.randrange(60))) for _ in range(600)]


def test_equals_brute_force(docs_of):
    texts = odd_texts()
    docs = docs_of(texts).withColumn("row", F.lit("clash")).withColumn("output", F.lit(1))
    for settings in ({}, {"fim_percent": 100, "spm_percent": 50, "seed": 7, "slice_bytes": 200}):
        rows = fill_in_middle.transform(docs, **settings).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        for r in rows:
            expected = brute(r.doc_id, texts[r.doc_id], settings.get("fim_percent", 90), settings.get("spm_percent", 20), settings.get("seed", 1))
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected
            assert r.back == (texts[r.doc_id] or "") and r.restored_sha256 == sha256(r.back) and r.output_sha256 == sha256(r.output)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "one two three")] * 2 + [(3, "one two three")] * 2, "doc_id long, text string")
    rows = fill_in_middle.transform(docs).collect()
    assert [tuple(r)[1:6] for r in rows] == [(*brute(k, "one two three")[:4], sha256(brute(k, "one two three")[4])) for k in (None, None, 3, 3)]
    assert fill_in_middle.transform(docs.limit(0)).count() == 0


def test_sql_and_query_agree_with_brute_force(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = queries.op13_fill_in_middle(spark, sf_dir)
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(db.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLE_SQL['op13_fill_in_middle']})").fetchall())
    texts = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    for doc_id, n, form, prefix, middle, output, restored in rows:
        expected = brute(doc_id, texts[doc_id])
        assert (n, form, prefix, middle, output, restored) == (*expected[:4], sha256(expected[4]), sha256(texts[doc_id] or ""))
