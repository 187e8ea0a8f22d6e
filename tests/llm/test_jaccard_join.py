import random
import re

from ledgerwake.llm import jaccard_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    links = [[j for j in range(len(texts)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(texts))]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(texts))]
    return label, [len(x) for x in links]


def test_equals_brute_force(docs_of, spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "SET_BLOCK", 8)
    draw = random.Random(6)
    texts = [None, "", "  ", "one two", "one  two", "one two three"]
    for _ in range(12):
        words = [draw.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(120)]
        for _ in range(draw.randrange(1, 9)):
            own = list(words)
            for _ in range(draw.randrange(4)):
                own[draw.randrange(len(own))] = "edit"
            texts.append(" ".join(own))
    texts.append("long " * 30_000)
    docs = docs_of(texts)
    label, links = brute(texts)
    got = {r.doc_id: r for r in jaccard_join.join(docs).collect()}
    assert [got[k].class_id for k in range(len(texts))] == label
    assert [got[k].n_links for k in range(len(texts))] == links
    assert {k for k, r in got.items() if r.chosen} == {k for k in range(len(texts)) if label[k] == k}


def test_keep_one(docs_of):
    same = "a b c d e f g"
    docs = docs_of([same, same, None, "", "other words are these ones"]).selectExpr("*", "1 AS h1", "2 AS _h1", "3 AS key")
    kept = jaccard_join.keep_one(docs.union(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 2, 3, 3, 4]
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_recall_of_stated_queries(spark):
    """Every id divisible by 100 against all rows: the number of links is that of the brute force for at least nine in ten links."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    got = {r.doc_id: r.n_links for r in jaccard_join.join(docs).filter("doc_id % 100 = 0").collect()}
    true = {k: sum(len(a & b) >= 0.8 * len(a | b) for j, b in sets.items() if j != k and b) if (a := sets[k]) else 0 for k in got}
    assert all(got[k] <= true[k] for k in got) and sum(got.values()) >= 0.9 * sum(true.values())
