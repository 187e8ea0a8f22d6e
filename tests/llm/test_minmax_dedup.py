import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwake.llm import minmax_dedup, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts, percent):
    """Sizes of the sets, and the least number that links of at least percent lead to, for texts numbered from 0."""
    sets = [shingles(x) for x in texts]
    label = list(range(len(texts)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    holders = {}
    for k, own in enumerate(sets):
        shared = {}
        for s in own:
            for other in holders.setdefault(s, []):
                shared[other] = shared.get(other, 0) + 1
            holders[s].append(k)
        for other, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[other]) - n):
                a, b = sorted((root(k), root(other)))
                label[b] = a
    return [len(s) for s in sets], [root(k) for k in range(len(texts))]


def edited(draw, words, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**9)}"
    return words


def near_copies():
    """Groups of copies around a base and chains of edits, texts without words, texts of few words."""
    draw = random.Random(12)
    texts = [None, "", " \n\t", "Ab cd", "aB CD", "ab cd ef", "É a b c d e f", "é a b c d e f", "\0 x"]
    for _ in range(25):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(6, 200))]
        for _ in range(draw.randrange(1, 9)):
            texts.append(" ".join(edited(draw, base, draw.randrange(4))).swapcase())
        for _ in range(draw.randrange(6)):
            base = edited(draw, base, 2)
            texts.append("\n".join(base))
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [300, 7])
def test_equals_brute_force(docs_of, monkeypatch, block):
    """Also where every group is dealt in blocks of a few members."""
    monkeypatch.setattr(minmax_dedup, "BLOCK", block)
    texts = near_copies()
    docs = docs_of(texts).withColumn("_group", F.lit("clash")).withColumn("number", F.lit(1)).withColumn("h1", F.lit(1))
    for percent in (85, 60) if block == 300 else (85,):
        sizes, label = brute(texts, percent)
        rows = minmax_dedup.near_duplicates(docs, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {k: (n, a, a == k) for k, (n, a) in enumerate(zip(sizes, label))}
        assert len(rows) == len(texts)


def test_a_large_group_of_near_copies(docs_of):
    """More members than blocks hold, some of them linked with a few others only; one cluster beside the largest."""
    draw = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(edited(draw, base, draw.randrange(3))) for _ in range(900)]
    far = edited(draw, base, 6)
    texts += [" ".join(edited(draw, far, 1)) for _ in range(350)] + [" ".join(base)] * 50
    draw.shuffle(texts)
    sizes, label = brute(texts, 85)
    rows = minmax_dedup.near_duplicates(docs_of(texts), 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == dict(enumerate(zip(sizes, label)))


def test_estimates_are_unbiased_and_vary_less():
    """Over many pairs of small sets that share half of their union: min and max of one permutation are then clearly less often equal together than apart."""
    draw, found = np.random.default_rng(1), []
    for _ in range(2000):
        own = draw.integers(0, 1 << 63, 6, np.uint64) * np.uint64(2)
        a, b = (np.frombuffer(minmax_dedup.min_max(x), np.uint8) for x in (own[:4], own[1:5] if _ % 2 else own[[0, 1, 2, 5]]))
        found.append((a == b).mean())
    true = 3 / 5
    expected = true + (1 - true) / 256
    assert abs(np.mean(found) - expected) < 0.005 and np.var(found) < 0.93 * expected * (1 - expected) / minmax_dedup.N_HASHES


def test_bounds():
    assert minmax_dedup.least_agreeing(0.85) < 0.85 * minmax_dedup.N_HASHES - 20
    assert minmax_dedup.N_BANDS * minmax_dedup.BAND == minmax_dedup.N_HASHES and (1 - 0.8**minmax_dedup.BAND) ** minmax_dedup.N_BANDS < 1e-4


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "x"), (7, "A b c"), (7, "other words here"), (9, "a b c"), (None, None), (None, None)], "doc_id long, text string")
    rows = minmax_dedup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=str) == sorted(
        [(None, 1, 7, False), (None, 1, None, True), (7, 1, 7, True), (7, 1, 7, True), (9, 1, 7, False), (None, 0, None, True), (None, 0, None, True)], key=str
    )
    assert minmax_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    sizes, label = brute([texts[k] for k in ids], 85)
    found = queries.op12_minmax_dedup(spark, sf_dir)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {tuple(r) for r in found.collect()} == {(k, n, ids[a], ids[a] == k) for k, n, a in zip(ids, sizes, label)}
