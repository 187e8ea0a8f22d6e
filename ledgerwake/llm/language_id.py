"""Language identification by error-correcting output codes over hashed letter n-grams.

Each language has a codeword; one binary logistic classifier predicts each of its bits from the square roots of a text's
n-gram shares. Decoding sums, for each language, the logistic loss of all bits against its codeword, a bit's loss weighted by
how well its classifier did on that language in training; the least loss wins, and a near tie is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, unit_hash, written

N_BUCKETS = 1 << 13
#: Texts that are counted at once, each in a row of N_BUCKETS numbers.
ROWS = 64
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
SLICE = 400_000
SAMPLE = "lang string, bucket array<int>, n array<float>"


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngram_counts(texts: list[str | None]) -> np.ndarray:
    """A row of N_BUCKETS counts for each text: n-grams of its lower-case letters, each run of other characters being one blank."""
    joined = "\0".join(f" {(x or '').lower()} ".replace("\0", " ") for x in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = points == 0
    owner = np.cumsum(ends, dtype=np.int64)
    points = np.where(_letters()[points], points, np.where(ends, 0, 32)).astype(np.uint32)
    keep = np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]
    points, owner = points[keep], owner[keep]
    counts = np.zeros(len(texts) * N_BUCKETS, np.int64)
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            continue
        mixed, whole = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32), np.ones(n, bool)
        for k in range(order):
            mixed = (mixed ^ points[k : n + k]) * _MULTIPLY[k]
            mixed ^= mixed >> np.uint32(15)
            whole &= points[k : n + k] != 0
        if order == 1:
            whole &= points != 32
        cell = owner[:n] * N_BUCKETS + (mixed % np.uint32(N_BUCKETS)).astype(np.int64)
        counts += np.bincount(cell[whole], minlength=len(counts))
    return counts.reshape(len(texts), N_BUCKETS)


def shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: every way to split the languages in two up to 7 of them, beyond that the best of 50 random codes by least distance. The same for the same n."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        columns = np.arange(1, 1 << (n - 1))
        return np.where(columns[None, :] >> np.arange(n)[::-1, None] & 1, 1, -1).astype(np.float32)
    bits, best, least = 10 * int(np.ceil(np.log2(n))), None, -1
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((n, bits)) < 0.5, 1, -1).astype(np.float32)
        products = code @ code.T - np.eye(n) * 2 * bits
        distance = (bits - products.max()) / 2
        if (np.abs(code.sum(axis=0)) < n).all() and distance > least:
            best, least = code, distance
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    #: Least lead of the best language's probability over the next one's.
    margin: float = 0.2

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its probability, and whether the choice is ambiguous, of each text. A null text and one without a letter are UNKNOWN, at probability 0. Of languages that are equally likely the first by name wins, and the choice is ambiguous."""
        lettered = np.array([any(map(str.isalpha, x or "")) for x in texts])
        if not self.languages or not len(texts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), lettered
        bits = shares(ngram_counts(texts)) @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -bits * row) * t).sum(axis=1) for row, t in zip(self.code, self.trust)], axis=1)
        near = np.exp(loss.min(axis=1, keepdims=True) - loss)
        chance = near / near.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        ranked = np.sort(chance, axis=1)
        second = ranked[:, -2] if ranked.shape[1] > 1 else np.zeros(len(texts))
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return names, np.where(lettered, ranked[:, -1], 0.0), lettered & (ranked[:, -1] - second < self.margin)


class SparseRows:
    """Rows of bucket counts as their shares, of which only a part at a time is spread out."""

    def __init__(self, buckets: list[np.ndarray], counts: list[np.ndarray], part: int = 512):
        self.ends = np.cumsum([0, *map(len, buckets)])
        self.bucket = np.concatenate([b.astype(np.uint16) for b in buckets])
        self.value = np.concatenate([np.sqrt(c / c.sum()).astype(np.float32) if len(c) else c for c in counts])
        self.part, self.n = part, len(buckets)

    def parts(self) -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, self.n, self.part):
            own = slice(at, min(self.n, at + self.part))
            inside = slice(self.ends[own.start], self.ends[own.stop])
            x = np.zeros((own.stop - own.start, N_BUCKETS), np.float32)
            x[np.repeat(np.arange(len(x)), np.diff(self.ends[own.start : own.stop + 1])), self.bucket[inside]] = self.value[inside]
            yield own, x


def fit_shares(rows: SparseRows, y: np.ndarray, languages: list[str], rounds: int = 80, ridge: float = 1e-5) -> LanguageModel:
    """y: the number of each row's language. All bits' logistic regressions at once, by accelerated gradient steps; rows weigh so that each language counts alike."""
    code = codewords(len(languages))
    sign = code[y]
    row_weight = (1.0 / np.bincount(y, minlength=len(languages))[y] / len(languages)).astype(np.float32)[:, None]
    w, b = np.zeros((N_BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    ahead_w, ahead_b, momentum, step = w, b, 1.0, np.float32(4.0)
    for _ in range(rounds):
        slope_w, slope_b = ridge * ahead_w, np.zeros_like(b)
        for own, x in rows.parts():
            error = -sign[own] * row_weight[own] / (1 + np.exp(np.clip(sign[own] * (x @ ahead_w + ahead_b), -50, 50)))
            slope_w, slope_b = slope_w + x.T @ error, slope_b + error.sum(axis=0)
        new_w, new_b = ahead_w - step * 8 * slope_w, ahead_b - step * slope_b
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        push = np.float32((momentum - 1) / following)
        ahead_w, ahead_b, w, b, momentum = new_w + push * (new_w - w), new_b + push * (new_b - b), new_w, new_b, following
    right = np.concatenate([(x @ w + b) * sign[own] > 0 for own, x in rows.parts()]).astype(np.float64)
    trust = np.stack([right[y == k].mean(axis=0) for k in range(len(languages))]) if languages else np.ones((0, 1))
    trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9) * code.shape[1]
    return LanguageModel(languages, code, w, b, trust)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_language: int = 400, most_rows: int = 16_000) -> LanguageModel:
    """Learns every language from a sample of about per_language rows of each, fewer where languages are so many that this would be more than about most_rows rows: that bound alone sets what the driver gathers, beyond one row a language.

    Rows are drawn by a hash of id and text, and the least hash of a language always is. Rows without text or language aren't
    used; without any, the model knows no language. A very long text counts by its shares, whole; repeated rows are drawn or
    left together. Extra columns aren't looked at.
    """
    known = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    hashed = known.withColumn("h", unit_hash("id", "text", seed=4))
    # written, so that Spark knows how small it is and doesn't shuffle the texts to join it
    amounts = written(hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("amount"), F.min("h").alias("least")), "languages")
    each = min(per_language, most_rows / max(1, amounts.count()))
    bounds = amounts.select("lang", F.greatest(F.lit(each) / F.col("amount"), "least").alias("bound"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at = 0
            for texts in in_slices(rows["text"].tolist(), SLICE, ROWS):
                langs = rows["lang"].to_numpy()[at : at + len(texts)]
                at += len(texts)
                counts = ngram_counts(texts)
                filled = [np.flatnonzero(c) for c in counts]
                yield pd.DataFrame({"lang": langs, "bucket": [f.astype(np.int32) for f in filled], "n": [c[f].astype(np.float32) for c, f in zip(counts, filled)]})

    drawn = hashed.join(bounds, "lang").filter("h <= bound").select("lang", "text")
    sample = drawn.mapInPandas(features, SAMPLE).toArrow()
    if not sample.num_rows:
        return LanguageModel([], np.ones((0, 1)), np.zeros((N_BUCKETS, 1)), np.zeros(1), np.ones((0, 1)))
    sample = sample.sort_by("lang")
    names = np.array(sample["lang"].to_pylist(), dtype=object)
    languages = sorted(set(names))
    number = {x: k for k, x in enumerate(languages)}
    rows = SparseRows([b.values.to_numpy() for b in sample["bucket"]], [n.values.to_numpy() for n in sample["n"]])
    return fit_shares(rows, np.array([number[x] for x in names]), languages)


def predict_column(text: Column, model: LanguageModel, spark) -> Column:
    """Struct lang, score, ambiguous of a text column, from the text alone: equal rows get equal structs, a very long text is read whole, an empty table gives none. Null, empty and letterless texts are UNKNOWN."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [shared.value.predict(own) for own in in_slices(texts, SLICE, ROWS)]
            yield pd.DataFrame({"lang": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts] or [np.zeros(0)]), "ambiguous": np.concatenate([p[2] for p in parts] or [np.zeros(0, bool)])})

    return predict(text)
