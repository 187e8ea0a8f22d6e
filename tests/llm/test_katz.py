import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwake.llm import katz

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["</s>"]


def kept(discounts, count):
    return float(discounts.kept(np.array([count]))[0])


def grams_of(tokens, length):
    """The n-gram that each token ends, with <s> for all words before the text."""
    padded = ["<s>"] * (length - 1) + tokens
    return [tuple(padded[i : i + length]) for i in range(len(tokens))]


class Brute:
    """The same model by dictionaries; P(word | context) by recursion."""

    def __init__(self, texts, order):
        self.order, tokens = order, [tokens_of(x) for x in texts]
        self.counts = [Counter(g for own in tokens for g in grams_of(own, k)) for k in range(1, order + 1)]
        n_of = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.MOST + 2)]
        self.discounts = [katz.Discounts.of(n_of(c)) for c in self.counts]
        self.total = sum(self.counts[0].values())
        self.unknown = 1 - sum(kept(self.discounts[0], c) for c in self.counts[0].values()) / self.total
        self.follow = [{} for _ in self.counts]
        for own, counts in zip(self.follow, self.counts):
            for gram, c in counts.items():
                own.setdefault(gram[:-1], []).append((gram[-1], c))
        self.alphas = {}

    def p(self, word, context):
        k = len(context)
        if not k:
            return kept(self.discounts[0], self.counts[0][word,]) / self.total if (word,) in self.counts[0] else self.unknown
        if context not in self.follow[k]:
            return self.p(word, context[1:])
        total = sum(c for _, c in self.follow[k][context])
        if (*context, word) in self.counts[k]:
            return kept(self.discounts[k], self.counts[k][*context, word]) / total
        if context not in self.alphas:
            left = 1 - sum(kept(self.discounts[k], c) for _, c in self.follow[k][context]) / total
            self.alphas[context] = left / (1 - sum(self.p(w, context[1:]) for w, _ in self.follow[k][context]))
        return self.alphas[context] * self.p(word, context[1:])

    def score(self, text):
        own = tokens_of(text)
        one, n = self.counts[0], len(self.counts[0])
        base = sum(math.log10((one[w,] + 1) / (self.total + n + 1)) for w in own)
        return len(own), sum((w,) in one for w in own), self.total, base, sum(math.log10(self.p(g[-1], g[:-1])) for g in grams_of(own, self.order))


def results(df):
    return {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()}


@pytest.mark.parametrize("order, salt, block", [(1, 4_000_000, 4000), (2, 50, 300), (3, 50, 4000)])
def test_equals_dictionaries(docs_of, spark, sf_dir, monkeypatch, order, salt, block):
    monkeypatch.setattr(katz, "SALT", salt)
    texts = [None, "", "The the THE", *[r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).collect()]]
    brute = Brute([x for k, x in enumerate(texts) if k % 3 != 1], order)
    scored, model = katz.score(docs_of(texts), F.col("doc_id") % 3 != 1, order=order, block_tokens=block)
    got = results(scored)
    for k, x in enumerate(texts):
        assert got[k] == pytest.approx(brute.score(x), rel=1e-9), k
    words = [w for w, in brute.counts[0]] + ["never seen"]
    for context in [*list(brute.follow[-1])[:20], ("not a context",) * (order - 1)]:
        assert sum(brute.p(w, context) for w in words) == pytest.approx(1.0, abs=1e-9)
    if order == 3:
        again = model.score(docs_of(texts).withColumn("row", F.lit("clash")))
        assert again.columns == [*docs_of(texts).columns, "row", "n_tokens", "score"]
        assert {r.doc_id: (r.n_tokens, r.score) for r in again.collect()} == {k: (v[0], pytest.approx(v[4], rel=1e-9)) for k, v in got.items()}
        assert model.ngrams(2).count() == len(brute.counts[1]) and model.words().count() == len(brute.counts[0])


def test_edges(docs_of, spark):
    none = katz.score(docs_of(["a b", None]), F.lit(False))[0].collect()
    assert [(r.n_known, r.train_tokens, r.score) for r in none] == [(0, 0, 0.0)] * 2
    assert katz.score(docs_of([]), F.lit(True))[0].count() == 0
    long = docs_of(["word " * 50_000, "word", None]).withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))
    nulls = long.withColumn("doc_id", F.lit(None).cast("long"))
    rows = katz.score(long.union(nulls), F.col("doc_id").isNotNull())[0].collect()
    score = {r.doc_id: r.score for r in rows}
    assert len(rows) == 6 and sorted(r.score for r in rows if r.doc_id is None) == pytest.approx(sorted(v for k, v in score.items() if k is not None))
