import hashlib
import random
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerwake.llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha256 = lambda x: hashlib.sha256(x.encode()).hexdigest()


def brute(words):
    """Stretches that keep each period in turn, without those that have a smaller one."""
    n, found, number = len(words), [], {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    for q in range(1, n // 4 + 1):
        edges = np.flatnonzero(np.diff(np.r_[0, (ids[:-q] == ids[q:]).view(np.int8), 0]))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            own = ids[i : j + q]
            if len(own) >= max(6, 4 * q) and not any((own[:-d] == own[d:]).all() for d in range(1, q)):
                found.append((i, len(own), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def with_tail(words, a, p):
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def without_repeats(words, runs):
    dropped = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def drawn(n=1500):
    draw = random.Random(11)
    texts = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 40, list("ab" * 20), list("aaaab" * 9), list("aab" * 4 + "aac" * 4)]
    for _ in range(n):
        words = [draw.choice("abcde"[: draw.choice((1, 2, 2, 3, 5))]) for _ in range(draw.randrange(70))]
        if words and draw.random() < 0.6:
            a = draw.randrange(len(words))
            words = with_tail(words, a, 1 + (len(words) - a) // (3 + draw.randrange(8))) + [draw.choice("ab") for _ in range(draw.randrange(4))]
        texts.append(words)
    return texts


def test_equals_brute_force():
    texts = drawn()
    for words, runs in zip(texts, periodic_runs.find_runs(texts), strict=True):
        assert [tuple(r) for r in runs.tolist()] == brute(words)
        assert periodic_runs.collapsed(words, runs) == without_repeats(words, brute(words)).split()
    assert periodic_runs.find_runs([]) == [] and [len(r) for r in periodic_runs.find_runs([[], []])] == [0, 0]


def test_classes_are_those_of_equal_factors():
    words = list("abaaabbcabacaacbcabcbacbcabcbacbcabcbacbc")
    n = len(words)
    classes = periodic_runs.EqualFactors(np.array([-1, *map(ord, words), -2]), np.zeros(n + 2, int), np.full(n + 2, n))
    for length in range(1, 12):
        true, own = {}, {}
        for i in range(n - length + 1):
            true.setdefault(tuple(words[i : i + length]), []).append(i + 1)
        for i in range(n + 2):
            own.setdefault(int(classes.cls[i]), []).append(i)
        large = sorted(g for g in own.values() if len(g) > 2)
        assert large == sorted(g for g in true.values() if len(g) > 2)
        assert all(classes.after[a] == b and classes.before[b] == a for g in large for a, b in zip(g, g[1:]))
        classes.refine()


def test_column(docs_of):
    texts = [None, "", " \n", "ja " * 6, "x\0 é " * 30, "ab " * 30_000, "one two three"] + [" ".join(w) for w in drawn(60)]
    rows = docs_of(texts).withColumn("r", F.lit("clash")).withColumn("runs", F.lit(1)).select("doc_id", periodic_runs.runs_column(F.col("text"), 20).alias("m")).withColumn("top", periodic_runs.longest(F.col("m.runs"))).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        words = WORD.findall(texts[r.doc_id] or "")
        expected = [(0, len(words), 1)] if len(words) == 30_000 else brute(words)
        assert (r.m.n_words, [tuple(x) for x in r.m.runs], r.m.collapsed) == (len(words), expected, without_repeats(words, expected))
        assert (tuple(r.top) if r.top else None) == min(expected, key=lambda x: (-x[1], x[0], x[2]), default=None)


def test_time_is_near_linear_in_prose_and_long_periods():
    draw = random.Random(3)
    words = [str(draw.randrange(5000)) for _ in range(200_000)]
    start = time.time()
    runs = periodic_runs.find_runs([words, with_tail(words[:20_000], 100, 4000)])
    assert runs[1].tolist() == [[100, 19_900, 4000]] and time.time() - start < 20


def test_query(spark, sf_dir):
    found = queries.op11_periodic_runs(spark, sf_dir)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert found.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = found.collect()
    assert len(rows) == len(texts) and any(r.n_runs for r in rows)
    for r in rows:
        words = WORD.findall(texts[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            words = with_tail(words, a, 1 + (n - a) // (3 + h // 10 % 8))
        runs = brute(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert tuple(r)[1:6] == (len(runs), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None)
        assert r.runs_sha256 == sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs)) and r.collapsed_sha256 == sha256(without_repeats(words, runs))
