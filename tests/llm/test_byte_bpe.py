import hashlib

import public_tokenizers as P
import tiktoken

from ledgerwake.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def test_equals_tiktoken(docs_of, spark, sf_dir):
    texts = [None, "", " ", "Hello  world\n\n don't", "日本語 ñandú 🙂🙂 \x00 <|endoftext|>", "a" * 3000, "ab" * 2000 + " " * 500, "x1y2" * 400]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    digests = byte_bpe.round_trip(spark, PATH, P.PATTERN, with_ids=True)
    for row in docs_of(texts).select("text", digests("text").alias("t")).collect():
        ids = known.encode_ordinary(row.text or "")
        assert row.t["ids"] == ids and row.t.n_tokens == len(ids)
        assert row.t.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.t.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    empty = docs_of([])
    assert empty.select(byte_bpe.encoder(spark, PATH, P.PATTERN)("text")).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(k).encode() for k in range(5000)]
    place = byte_bpe.MinimalPerfectHash(keys)
    assert sorted(map(place, keys)) == list(range(5000))
