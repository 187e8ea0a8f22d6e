import hashlib

import corpus_pipeline


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        if name != "byte_bpe":
            assert docs.columns == columns
            rows = docs.collect()
            texts = {r.doc_id: r.text for r in rows}
            assert set(texts) <= set(before)
            if name == "quality_classifier":
                good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
                assert len(good & set(texts)) >= 0.98 * len(good & set(before))
            if name in ("quality_classifier", "jaccard_join"):
                assert all(before[i] == t for i, t in texts.items())
            if name == "jaccard_join":
                assert len(rows) < len(before)
            if name == "pii":
                assert set(texts) == set(before) and any(before[i] != t for i, t in texts.items())
            before = texts
            last = rows
    assert sorted((r.doc_id, r.decoded_sha256) for r in docs.collect()) == sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in last)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "pii", "mixing", "byte_bpe"]
