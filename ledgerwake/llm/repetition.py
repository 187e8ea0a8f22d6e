"""Quality rules from repetition inside a text: a suffix array over its words, its longest common prefixes, and their intervals.

The suffixes of many texts are ranked together, by prefix doubling in numpy: each round sorts only the suffixes that some
other suffix of the same text still equals, so that ordinary prose needs a round or two.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import WORD, in_slices

#: Words of a window of the base rule, and so the shortest repeat that counts.
SHORTEST = 5
_SYMBOL = re.compile(r"[#*$%&|<>]")


def suffix_ranks(ids: np.ndarray, texts: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words; the last level tells apart all suffixes. ids: the words, texts: the number of the text that each stands in, rising. Suffixes of different texts differ, and one that ends sorts before one that goes on."""
    n = len(ids)
    _, rank = np.unique(texts.astype(np.int64) * (int(ids.max()) + 1) + ids if n else ids, return_inverse=True)
    levels, step = [rank], 1
    while n:
        same = np.bincount(rank)[rank] > 1
        if not same.any():
            break
        at = np.flatnonzero(same)
        follow = np.full(len(at), -1, np.int64)
        inside = at + step < n
        inside[inside] = texts[at[inside] + step] == texts[at[inside]]
        follow[inside] = rank[at[inside] + step]
        order = np.lexsort((follow, rank[at]))
        first, second = rank[at][order], follow[order]
        starts = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        heads = np.r_[True, first[1:] != first[:-1]]
        head_at, start_at = np.flatnonzero(heads), np.flatnonzero(starts)
        # a rank is the number of smaller suffixes, so that those which are equal leave room for a later round
        rank = (np.cumsum(np.bincount(rank)) - np.bincount(rank))[rank]
        smaller = np.arange(len(at)) - np.repeat(head_at, np.diff(np.r_[head_at, len(at)]))
        places = np.empty(len(at), np.int64)
        places[order] = np.repeat(smaller[start_at], np.diff(np.r_[start_at, len(at)]))
        rank[at] += places
        levels.append(rank)
        step *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and for each place in it the length of the common prefix with the suffix before (0 at the first)."""
    n = len(texts)
    order = np.argsort(levels[-1], kind="stable")
    lcp = np.zeros(n, np.int64)
    alike = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]]) + 1 if n else order
    a, b = order[alike - 1], order[alike]
    whose, got = texts[a], np.zeros(len(alike), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = np.flatnonzero((a < n) & (b < n))
        at = at[(levels[k][a[at]] == levels[k][b[at]]) & (texts[a[at]] == whose[at]) & (texts[b[at]] == whose[at])]
        for x in (got, a, b):
            x[at] += 1 << k
    lcp[alike] = got
    return order, lcp


def lcp_intervals(lcp: np.ndarray, shortest: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each interval of the suffix array whose suffixes share a prefix of at least the shortest length, and no longer one in a larger interval."""
    at = np.flatnonzero(lcp >= shortest)
    stack: list[tuple[int, int]] = []
    before = -2
    for i in [*at.tolist(), -1]:
        value = int(lcp[i]) if i >= 0 else 0
        start = i - 1
        if i != before + 1 or i < 0:  # what was open ends before the gap
            while stack:
                length, start_at = stack.pop()
                yield length, start_at, before
            start = i - 1
        while stack and stack[-1][0] > value:
            length, start = stack.pop()
            yield length, start, i - 1
        if i >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, start))
        before = i


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, ids: np.ndarray, texts: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (length in words, first, last) of the intervals whose prefix can't be made longer on either side without losing an occurrence: its occurrences start at order[first : last + 1]."""
    found = np.array(list(lcp_intervals(lcp, shortest)), np.int64).reshape(-1, 3)
    # the word before each suffix; before the first one of a text stands something that no other has
    inside = np.r_[False, texts[1:] == texts[:-1]] if len(texts) else np.zeros(0, bool)
    before = np.where(inside, np.r_[0, ids[:-1]], -1 - texts)[order]
    changes = np.cumsum(np.r_[0, before[1:] != before[:-1]])
    return found[changes[found[:, 2]] > changes[found[:, 1]]]


def longest_at(order: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """For each word the length of the longest of the repeats that starts at it, 0 for none. Intervals lie apart or inside each other; the longest prefixes, which are the innermost, come first, and each place is filled once."""
    length = np.zeros(len(order), np.int64)
    following: dict[int, int] = {}  # from where something filled begins to the place after it
    for size, first, last in repeats[np.argsort(-repeats[:, 0], kind="stable")].tolist():
        at = first
        while at <= last:
            if at in following:
                at = following[at]
            else:
                length[at] = size
                at += 1
        following[first] = last + 1
    out = np.zeros(len(order), np.int64)
    out[order] = length
    return out


def covered_words(lengths: np.ndarray) -> np.ndarray:
    """Which places lie in the union of the spans [i, i + lengths[i])."""
    n = len(lengths)
    at = np.flatnonzero(lengths)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + lengths[at], n), -1)
    return np.cumsum(steps[:n]) > 0


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_repeats long, longest_repeat long, covered_chars long, spans array<struct<start:int,end:int>>"


def _dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    worded = [x for x in lines if WORD.search(x)]
    return len(worded) - len(set(worded))


def measure(texts: list[str | None], shortest: int = SHORTEST) -> list[dict]:
    """The counts of FIELDS for each text. spans: the union of all occurrences of its maximal repeats, in code points, adjoining ones joined. covered_chars: the code points of the words in them, so that blanks count on neither side of a fraction of word_chars."""
    words = [WORD.findall(x or "") for x in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    number: defaultdict[str, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, total)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order, lcp = common_prefixes(suffix_ranks(ids, owner), owner) if total else (ids, ids)
    found = maximal_repeats(order, lcp, ids, owner, shortest)
    whose = owner[order[found[:, 1]]]
    longest, repeats = np.zeros(len(texts), np.int64), np.bincount(whose, minlength=len(texts))
    np.maximum.at(longest, whose, found[:, 0])
    covered = covered_words(longest_at(order, found)) if total else np.zeros(0, bool)
    ends = np.cumsum(sizes)
    out = []
    for k, (x, own_words) in enumerate(zip(texts, words)):
        own = covered[ends[k] - sizes[k] : ends[k]]
        spans = []
        if own.any():
            edges = np.flatnonzero(np.diff(np.r_[0, own.view(np.int8), 0])).tolist()
            at = [m.span() for m in WORD.finditer(x)]
            spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]
        out.append({
            "n_words": len(own_words), "word_chars": sum(map(len, own_words)), "n_symbols": len(_SYMBOL.findall(x or "")), "n_dup_lines": _dup_lines(x or ""),
            "n_repeat_words": int(own.sum()), "n_repeats": int(repeats[k]), "longest_repeat": int(longest[k]),
            "covered_chars": sum(len(w) for w, inside in zip(own_words, own.tolist()) if inside) if spans else 0, "spans": spans,
        })
    return out


def repetition_column(text: Column, shortest: int = SHORTEST, words_at_once: int = 300_000) -> Column:
    """Struct of FIELDS for a text column. A null text counts as empty: all 0 and no spans. Texts are taken together up to a number of characters; one that is longer is taken alone and whole. Equal rows get equal structs, and an empty table none; no other column is looked at."""

    @F.pandas_udf(FIELDS)
    def repetition(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [row for own in in_slices(texts, 6 * words_at_once) for row in measure(own, shortest)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])

    return repetition(text)


def base_failed(r: Column, shortest_text: int = 10, repeat_percent: int = 20) -> Column:
    return (r["n_words"] < shortest_text) | (100 * r["n_repeat_words"] > repeat_percent * r["n_words"])


def repeats_within(r: Column, covered_percent: int = 20, longest: int = 50) -> Column:
    """The method's verdict: maximal repeats cover at most this part of the characters in words, and none is longer than so many words."""
    return (100 * r["covered_chars"] <= covered_percent * r["word_chars"]) & (r["longest_repeat"] <= longest)
