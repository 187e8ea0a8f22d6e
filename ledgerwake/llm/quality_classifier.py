"""Quality classifier: ordinal regression of graded ratings on hashed text, by the cumulative logit model.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all grades and rising thresholds. x holds a 1 for each
hashed lower-case word of the text, the shares of the hashed shapes of its words and of words that repeat the one before, and
the square roots of the shares of the hashed starts of its words, so that inflected and compound words speak for their stem.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import sqrt
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Recent, spare, unit_hash, written

N_BUCKETS = 1 << 22
#: How much a share of 1 counts against the 1 of a word that is there.
SHARE = 6.0
#: Letters of a word's start; shorter words have none.
START = 5
#: The most and the least that the cut on the chance of the highest grade can be: see best_cut.
LEAST_CHANCE, LEAST_CUT = 0.85, 0.5
#: Parts of the ratings; each is graded by a model of the others to find the cut.
N_FOLDS = 4
#: About the most rated texts, and the most distinct buckets of all of them together, that are learned from: see sample.
MOST_ROWS, MOST_ENTRIES = 16_000, 1 << 23
#: Entries that the driver works on at a time, and tasks in which the sample is told apart.
SLICE, SAMPLE_TASKS = 1 << 20, 32
_CORE = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"(.)\1+", re.S)


def _bucket(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{value}".encode()) % N_BUCKETS


_REPEAT = _bucket("repeat", "")


def shape(word: str) -> str:
    """The word's kinds of characters, each run once: Thnd*** has Aa*."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", kinds)


def _word(word: str) -> tuple[tuple[int, ...], tuple[int, ...], int]:
    """Buckets of the letter runs in the word, of their starts, and of its shape."""
    cores = _CORE.findall(word.lower())
    return tuple(_bucket("word", x) for x in cores), tuple(_bucket("start", x[:START]) for x in cores if len(x) >= START), _bucket("shape", shape(word))


class Features:
    def __init__(self):
        self.known = Recent(_word)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of the whole text and their values; none for a null or empty text."""
        words = WORD.findall(text or "")
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        known, present, begun, shapes = self.known, set(), {}, Counter()
        for word, n in Counter(words).items():
            cores, starts, own_shape = known[word]
            present.update(cores)
            for start in starts:
                begun[start] = begun.get(start, 0) + n
            shapes[own_shape] += n
        if repeats := sum(map(eq, words, words[1:])):
            shapes[_REPEAT] += repeats
        share = {b: SHARE * sqrt(n / len(words)) for b, n in begun.items()} | {b: SHARE * n / len(words) for b, n in shapes.items()}
        present.difference_update(share)
        buckets = np.fromiter((*present, *share), np.int64, len(present) + len(share))
        values = np.ones(len(buckets), np.float32)
        values[len(present) :] = list(share.values())
        return buckets, values


@dataclass
class OrdinalModel:
    #: the buckets that have a weight, and their weights
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, level: np.ndarray) -> np.ndarray:
        """P(grade = k) for each value of w.x."""
        below = 1 / (1 + np.exp(np.clip(level[:, None] - self.thresholds[None, :], -60, 60)))
        return np.diff(np.c_[np.zeros(len(level)), below, np.ones(len(level))], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _slopes(level: np.ndarray, cuts: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's log likelihood: the part of its upper threshold and that of its lower one; level has the negative of their sum."""
    edge = np.r_[-np.inf, cuts, np.inf]
    up, low = (np.where(np.isinf(e), e > 0, _sigmoid(np.where(np.isinf(e), 0, e) - level)) for e in (edge[grades + 1], edge[grades]))
    p = np.maximum(up - low, 1e-9)
    return up * (1 - up) / p, -low * (1 - low) / p


def _summed(column: np.ndarray, n: int, weights: Callable[[slice], np.ndarray] | None = None) -> np.ndarray:
    """np.bincount of the column, SLICE entries at a time, so that its copies stay small; weights gives those of a slice."""
    total = np.zeros(n, np.float64 if weights else np.int64)
    for at in range(0, len(column), SLICE):
        own = slice(at, at + SLICE)
        total += np.bincount(column[own], weights(own) if weights else None, n)
    return total


def _climb(column: np.ndarray, owner: np.ndarray, x: np.ndarray, grades: np.ndarray, w: np.ndarray, cuts: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Adam on weights and thresholds (the first one and the logarithms of the gaps), from where they are."""
    d, n, n_grades = len(w), len(grades), len(cuts) + 1
    params = np.r_[w, cuts[0], np.log(np.maximum(np.diff(cuts), 1e-6))]
    first, second = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, rounds + 1):
        gaps = np.exp(params[d + 1 :])
        upper, lower = _slopes(np.bincount(owner, params[:d][column] * x, n), params[d] + np.r_[0, np.cumsum(gaps)], grades)
        up_by_cut = (np.bincount(grades, upper, n_grades)[:-1] + np.bincount(grades, lower, n_grades)[1:]) / n
        grad = np.r_[np.bincount(column, (upper + lower)[owner] * x, d) / n + ridge / n * params[:d], -up_by_cut.sum(), -np.cumsum(up_by_cut[::-1])[::-1][1:] * gaps]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        rate = 0.1 * min(1.0, 2 * (1 - k / rounds) + 0.02)
        params -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return params[:d], params[d] + np.r_[0, np.cumsum(np.exp(params[d + 1 :]))]


def fit_ordinal(bucket: np.ndarray, value: np.ndarray, sizes: np.ndarray, grades: np.ndarray, n_grades: int, least_docs: int = 5, least_z: float = 4.5, most_buckets: int = 4096, ridge: float = 0.3, rounds: int = 200) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty. bucket, value: those of all rows in turn; sizes: how many each row has.

    Only buckets that tell something get a weight: in turns, those whose score test against the model so far is at least
    least_z join it, the strongest first and at most as many as it has, and all weights are fitted anew. Buckets of fewer than
    least_docs rows never do. Grades that don't occur make their threshold gap shrink to about 0.
    """
    keep = _summed(bucket, N_BUCKETS) >= least_docs
    buckets, used = np.flatnonzero(keep), keep[bucket]
    place = np.cumsum(keep, dtype=np.int32) - 1
    column, owner, x = place[bucket[used]], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[used], value[used]
    del used, keep, place
    n, d = max(1, len(sizes)), len(buckets)
    below = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 0.01, 0.99)
    start = np.log(below / (1 - below))
    cuts = start[0] + np.r_[0, np.cumsum(np.maximum(np.diff(start), 0.1))]
    norm, w, active = np.sqrt(_summed(column, d, lambda own: x[own] * x[own])), np.zeros(d), np.zeros(d, bool)
    while active.sum() < most_buckets:
        inside = np.flatnonzero(active[column])
        slope = -np.add(*_slopes(np.bincount(owner[inside], w[column[inside]] * x[inside], n), cuts, grades))
        z = np.abs(_summed(column, d, lambda own: slope[owner[own]] * x[own])) / (norm * np.sqrt(np.mean(slope**2)) + 1e-12)
        z[active] = 0
        room = min(max(16, int(active.sum())), most_buckets - int(active.sum()))
        joining = np.argsort(-z, kind="stable")[:room]
        joining = joining[z[joining] >= least_z]
        if not len(joining):
            break
        active[joining] = True
        at, inside = np.flatnonzero(active), np.flatnonzero(active[column])
        w[at], cuts = _climb(np.searchsorted(at, column[inside]), owner[inside], x[inside].astype(np.float64), grades, w[at], cuts, ridge, rounds)
    at, inside = np.flatnonzero(active), np.flatnonzero(active[column])
    return OrdinalModel(buckets[at], w[at].astype(np.float32), cuts)


def _folds(keys: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """A fold for each row: those of a grade are dealt out evenly by the order of their keys, equal keys together."""
    fold = np.zeros(len(keys), np.int64)
    for grade in np.unique(grades):
        own = grades == grade
        fold[own] = np.unique(keys[own], return_inverse=True)[1] % N_FOLDS
    return fold


def held_out_chances(bucket: np.ndarray, value: np.ndarray, sizes: np.ndarray, grades: np.ndarray, n_grades: int, keys: np.ndarray) -> np.ndarray:
    """Each row's chance of the highest grade by a model that was fitted to the other folds, or the part of all ratings that have it where there is no such model or it has no weights; rows of equal keys and grades share a fold."""
    fold, chances = _folds(keys, grades), np.full(len(grades), np.mean(grades == n_grades - 1))
    for k in np.unique(fold):
        out = fold == k
        if out.all():
            continue
        rest = np.repeat(~out, sizes)
        model = fit_ordinal(bucket[rest], value[rest], sizes[~out], grades[~out], n_grades)
        if not len(model.buckets):
            continue
        weight = np.zeros(N_BUCKETS, np.float32)
        weight[model.buckets] = model.weights
        rest = ~rest
        level = np.bincount(np.repeat(np.arange(out.sum()), sizes[out]), weight[bucket[rest]] * value[rest], out.sum())
        chances[out] = model.chances(level)[:, -1]
    return chances


def best_cut(chances: np.ndarray, good: np.ndarray, least_chance: float = LEAST_CHANCE) -> float:
    """The chance that a document needs, from held-out chances of the ratings: one that separates good from other ones best.

    A cut's worth is the part of the good ones that reach it less that part of the others, so that neither the mix of the
    ratings nor a few wrong ones move it far. Of those within a standard error of the best, it is the one nearest to the part
    of good ones among the ratings, which a sound model's best cut equals. It is at most least_chance; at least LEAST_CUT, or
    that part where it is less.
    """
    if good.all() or not good.any():
        return least_chance
    share = float(good.mean())
    known = np.unique(chances)
    cuts = np.r_[share, (known[1:] + known[:-1]) / 2]
    kept, passed = (1 - np.searchsorted(np.sort(chances[own]), cuts) / own.sum() for own in (good, ~good))
    worth = kept - passed
    best = int(np.argmax(worth))
    error = np.sqrt(kept[best] * (1 - kept[best]) / good.sum() + passed[best] * (1 - passed[best]) / (~good).sum())
    near = cuts[worth >= worth[best] - error]
    cut = float(near[np.argmin(np.abs(near - share))])
    return min(least_chance, max(cut, min(LEAST_CUT, share)))


def grade_column(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 poor, 1 good but toxic, 2 good; null where a rating is null."""
    return (F.col(quality) * (2 - F.col(toxic))).cast("int")


def sample(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, id_col: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """The rated texts to learn from, as a written table of id_hash, grade, key (the text's hash), bucket and value; each of these triples once.

    Ratings (id_col, grade) of about most_rows documents at most, drawn by a hash of the id, are looked up; of the rows found,
    as many as have about most_entries buckets together, and are about most_rows, are drawn by a hash of the three. So neither
    long texts, nor an id with many texts, make the sample larger. Null ids, grades and texts aren't used.
    """
    rated = ratings.filter(F.col(id_col).isNotNull() & F.col("grade").between(0, n_grades - 1)).select(F.col(id_col).alias("_rated_id"), "grade").distinct()
    drawn = rated.filter(unit_hash("_rated_id", seed=5) < most_rows / max(1, rated.count()))

    order = ["id_hash", "grade", "key"]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract, seen = Features(), set()
        for rows in batches:
            new = []
            for k, own in enumerate(zip(rows["id_hash"].tolist(), rows["grade"].tolist(), rows["key"].tolist())):
                if own not in seen:
                    seen.add(own)
                    new.append(k)
            found = [extract(x) for x in rows["text"].iloc[new]]
            yield rows[order].iloc[new].assign(bucket=[f[0].astype(np.int32) for f in found], value=[f[1] for f in found])

    joined = docs.select(F.col(id_col).alias("_doc_id"), F.col(text).alias("text")).join(F.broadcast(drawn), F.col("_doc_id") == F.col("_rated_id"))
    read = joined.filter(F.col("text").isNotNull()).select(F.xxhash64("_rated_id").alias("id_hash"), "grade", F.xxhash64("text").alias("key"), "text")
    found = read.mapInPandas(features, "id_hash long, grade int, key long, bucket array<int>, value array<float>")
    # a task gives each row once, so that a repeated one doesn't bring its likes together here
    rows = written(found.repartition(SAMPLE_TASKS, *order).dropDuplicates(order), "ratings")
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("bucket").cast("long")).alias("entries")).first()
    part = min(1.0, most_rows / max(1, size["rows"]), most_entries / max(1, size["entries"] or 0))
    return rows if part == 1 else rows.filter(unit_hash(*order, seed=6) < part)


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, id_col: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS, least_chance: float = LEAST_CHANCE, most_entries: int = MOST_ENTRIES) -> tuple[OrdinalModel | None, float]:
    """The model, and the chance of the highest grade from which a document is kept. Learns from the sample of the ratings: most_rows and most_entries bound what the driver gathers. A rating, or a row of docs, that is repeated counts once. The model is None if fewer than two grades are left: then there is nothing to tell apart. Where no word or shape tells the grades apart, the cut is 0."""
    order = ["id_hash", "grade", "key"]
    rows = sample(docs, ratings, n_grades, id_col, text, most_rows, most_entries).repartition(SAMPLE_TASKS, *order).sortWithinPartitions(*order).toArrow()
    grades = rows["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grades)) < 2:
        return None, 0.0
    flat = lambda name: np.concatenate([c.flatten().to_numpy() for c in rows[name].chunks])
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in rows["bucket"].chunks])
    bucket, value, keys = flat("bucket"), flat("value"), rows["key"].to_numpy()
    del rows
    pa.default_memory_pool().release_unused()
    model = fit_ordinal(bucket, value, sizes, grades, n_grades)
    if not len(model.buckets):
        return model, 0.0
    return model, best_cut(held_out_chances(bucket, value, sizes, grades, n_grades, keys), grades == n_grades - 1, least_chance)


def grade_chances(text: Column, model: OrdinalModel | None, spark, n_grades: int = 3) -> Column:
    """Struct expected_grade, tail (array: P(grade >= k) for k from 1). Without a model every text has the highest grade for sure. A null text counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, extract = shared.value, Features()
        weight = np.zeros(N_BUCKETS, np.float32)
        if own:
            weight[own.buckets] = own.weights
        for texts in batches:
            if own is None:
                yield pd.DataFrame({"expected_grade": float(n_grades - 1), "tail": [np.ones(n_grades - 1)] * len(texts)})
                continue
            level = np.zeros(len(texts))
            for k, x in enumerate(texts):
                buckets, values = extract(x)
                level[k] = weight[buckets] @ values
            tail = 1 - np.cumsum(own.chances(level), axis=1)[:, :-1]
            yield pd.DataFrame({"expected_grade": tail.sum(axis=1), "tail": list(tail)})

    return predict(text)


def select_good(docs: DataFrame, ratings: DataFrame, least_chance: float = LEAST_CHANCE, n_grades: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose chance of the highest grade is at least that of best_cut, which is least_chance at most.

    A null or empty text is graded by the thresholds alone; a very long one by all its words. Repeated rows are graded alike.
    Without ratings that tell anything apart all rows stay. An empty table stays empty; extra columns may have any name.
    """
    model, cut = fit(docs, ratings, n_grades, id_col, text, least_chance=least_chance)
    chances = spare("_chances", docs.columns)
    scored = docs.withColumn(chances, grade_chances(F.col(text), model, docs.sparkSession, n_grades))
    return scored.filter(F.col(chances)["tail"][n_grades - 2] >= cut).drop(chances)
