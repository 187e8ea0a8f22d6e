"""Runs: stretches of words that repeat with a period, found by refining classes of equal factors.

Positions at which equal factors of some length start form a class. From one length to the next a class falls apart by the
classes of the positions that follow; only the smaller parts of what fell apart before have to be looked at, so that each
position is touched a logarithmic number of times. Where a member of a class and the next one lie just as far apart as the
factor is long, the factor stands twice in a row: a square, whose root is primitive since nothing lies between. Squares of
one period at neighbouring places make a run. Many texts are refined together, in numpy.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import WORD, in_slices

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first one does."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _largest(groups: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which row is the first of the largest of its group."""
    order = np.lexsort((-sizes, groups))
    first = np.zeros(len(groups), bool)
    first[order] = _starts(groups[order])
    return first


class EqualFactors:
    """Classes of the positions at which equal factors of a length start: 1 word at first.

    order holds the members of each class side by side; after and before link them by position. A run of four periods has at
    least three members of a class at each of its squares, so smaller classes aren't refined further; nor are the positions of
    a text beyond the length in deepest. keys: equal words of one text have equal keys, no others do.
    """

    def __init__(self, keys: np.ndarray, owner: np.ndarray, deepest: np.ndarray):
        n = len(keys)
        first, cls, size = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)[1:]
        self.length, self.deepest, self.cls, self.end = 1, deepest, cls.astype(np.int32), n
        self.order = np.argsort(cls, kind="stable").astype(np.int32)
        self.place = np.empty(n, np.int32)
        self.place[self.order] = np.arange(n)
        self.n_classes = len(size)
        self.size, self.start = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.size[: len(size)], self.start[: len(size)] = size, np.cumsum(size) - size
        # the last entry stands for no neighbour
        self.after, self.before = np.full(n + 1, n, np.int32), np.full(n + 1, n, np.int32)
        a, b = self.order[:-1], self.order[1:]
        alike = self.cls[a] == self.cls[b]
        self.after[a[alike]], self.before[b[alike]] = b[alike], a[alike]
        self.small = np.flatnonzero(~_largest(owner[first], size))
        self._moved = np.zeros(n, bool)

    def gaps(self, at: np.ndarray) -> np.ndarray:
        """How far the next member of its class is from each position; 0 for the last one."""
        following = self.after[at]
        return np.where(following == self.end, 0, following - at)

    def lives(self, at: np.ndarray) -> np.ndarray:
        return (self.size[self.cls[at]] >= LEAST_PERIODS - 1) & (self.deepest[at] >= self.length)

    def refine(self) -> np.ndarray:
        """To factors of one more word. The positions whose next member is another one now."""
        ids = self.small
        size = self.size[ids]
        at = self.order[_ranges(self.start[ids], size)] - 1
        self.length += 1
        self.small = ids[:0]
        lives = self.lives(at)
        at, follows = at[lives], np.repeat(ids, size)[lives]
        if not len(at):
            return at
        order = np.lexsort((at, follows, self.cls[at]))
        at, follows = at[order], follows[order]
        own = self.cls[at]
        new_class = _starts(own)
        heads = np.flatnonzero(_starts(own, follows))
        part_size, group = np.diff(heads, append=len(at)), (np.cumsum(new_class) - 1)[heads]
        classes = own[new_class]
        # of a class that goes whole, the largest part keeps the name
        whole = np.bincount(group, part_size).astype(np.int64) == self.size[classes]
        goes = ~(whole[group] & _largest(group, part_size))
        at, part_size, group = at[np.repeat(goes, part_size)], part_size[goes], group[goes]
        if not len(at):
            return at
        new = self.n_classes + np.arange(len(group))
        self.n_classes += len(new)
        left = self._unlink(at, np.repeat(classes[group], part_size))
        self.after[at[:-1]], self.before[at[1:]] = at[1:], at[:-1]
        ends = np.cumsum(part_size)
        self.after[at[ends - 1]], self.before[at[ends - part_size]] = self.end, self.end
        self._place(at, new, part_size, group, classes)
        return np.concatenate([at, left])

    def _unlink(self, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Takes positions out of their classes' chains; those that now have another neighbour after them."""
        ordered = at[np.lexsort((at, own))]
        breaks = np.flatnonzero(self.after[ordered[:-1]] != ordered[1:])
        left, right = self.before[ordered[np.append(0, breaks + 1)]], self.after[ordered[np.append(breaks, len(ordered) - 1)]]
        self.after[left], self.before[right] = right, left
        return left[left != self.end]

    def _place(self, at: np.ndarray, new: np.ndarray, part_size: np.ndarray, group: np.ndarray, classes: np.ndarray) -> None:
        """Moves positions, sorted by the parts that they make, to the end of their classes' stretches of order, names the parts, and chooses what is small."""
        taken = np.bincount(group, part_size, len(classes)).astype(np.int32)
        hit = taken > 0
        first = self.start[classes] + self.size[classes] - taken
        slots = _ranges(first[hit], taken[hit])
        self._moved[at] = True
        homeless = self.order[slots]
        homeless = homeless[~self._moved[homeless]]
        self._moved[at] = False
        vacant = self.place[at]
        vacant = vacant[vacant < np.repeat(first[group], part_size)]
        self.order[vacant], self.place[homeless] = homeless, vacant
        self.order[slots], self.place[at] = at, slots
        self.start[new], self.size[new] = slots[np.cumsum(part_size) - part_size], part_size
        self.cls[at] = np.repeat(new, part_size)
        self.size[classes] -= taken
        names, groups = np.concatenate([classes[hit], new]), np.concatenate([np.flatnonzero(hit), group])
        self.small = names[~_largest(groups, self.size[names])]


def squares(classes: EqualFactors) -> Iterator[tuple[int, np.ndarray]]:
    """(period, rising positions at which a word sequence of the period's length stands twice in a row, with a primitive root), period after period."""
    later: defaultdict[int, list[np.ndarray]] = defaultdict(list)
    changed, until, soon, soon_gaps = np.zeros(0, np.int32), 1, None, None
    while True:
        period = classes.length
        if period == until:  # gaps of the next octave are sorted at once, those that change within it one by one
            until *= 2
            soon = np.flatnonzero((classes.size[classes.cls] >= LEAST_PERIODS - 1) & (classes.deepest >= period))
            gaps = classes.gaps(soon)
            within = (gaps >= period) & (gaps < until)
            soon, gaps = soon[within], gaps[within]
            order = np.argsort(gaps, kind="stable")
            soon, soon_gaps = soon[order], gaps[order]
        elif len(changed):
            gaps = classes.gaps(changed)
            within = (gaps >= period) & (gaps < until)
            at, gaps = changed[within], gaps[within]
            order = np.argsort(gaps, kind="stable")
            at, gaps = at[order], gaps[order]
            heads = np.flatnonzero(_starts(gaps))
            for a, b, gap in zip(heads, [*heads[1:], len(gaps)], gaps[heads].tolist()):
                later[gap].append(at[a:b])
        low, high = np.searchsorted(soon_gaps, [period, period + 1])
        due = later.pop(period, [])
        if low < high or due:
            at = np.unique(np.concatenate([soon[low:high], *due]))
            at = at[(classes.gaps(at) == period) & classes.lives(at)]
            if len(at):
                yield period, at
        if not len(classes.small):
            return  # nothing falls apart any more: no class is left
        changed = classes.refine()


def find_runs(texts: list[list[str]], least_words: int = LEAST_WORDS) -> list[np.ndarray]:
    """For each sequence of words its runs of at least least_words words and LEAST_PERIODS periods: rows (start, length, period) by start, then period."""
    sizes = np.array([len(w) for w in texts], np.int64)
    number: defaultdict[str, int] = defaultdict(count().__next__)
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    # a place of its own before the first text and after each, so that no factor reaches into another text
    ends = np.cumsum(sizes + 1)
    n = int(ends[-1]) + 1 if len(sizes) else 1
    owner = np.r_[0, np.repeat(np.arange(len(sizes)), sizes + 1)]
    keys = -1 - np.arange(n)
    inside = np.ones(n, bool)
    inside[np.r_[ends - sizes - 1, n - 1]] = False
    keys[inside] = owner[inside] * max(1, len(number)) + words
    found = []
    if len(words):
        classes = EqualFactors(keys, owner, sizes[owner] // LEAST_PERIODS)
        for period, at in squares(classes):
            breaks = np.flatnonzero(np.diff(at) != 1)
            start, last = at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]]
            length = last - start + 2 * period
            long = length >= max(least_words, LEAST_PERIODS * period)
            found.append(np.stack([start[long], length[long], np.full(long.sum(), period)], axis=1))
    runs = np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    whose = owner[runs[:, 0]]
    runs[:, 0] -= (ends - sizes)[whose] if len(sizes) else 0
    return np.split(runs, np.searchsorted(whose, np.arange(1, len(sizes)))) if len(sizes) else []


def collapsed(words: list[str], runs: np.ndarray) -> list[str]:
    """The words without those that stand in a run after its first period."""
    if not len(runs):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(steps[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def runs_column(text: Column, words_at_once: int = 400_000) -> Column:
    """Struct of RUNS for a text column: number of words, all runs by start and period, and the words that no run repeats, joined by one space.

    A null text counts as empty: no words, no runs, an empty collapsed text. Texts are refined together up to a number of
    characters; one that is longer is taken alone and whole. Equal rows get equal structs, an empty table none; no other
    column is looked at.
    """

    @F.pandas_udf(RUNS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for own in in_slices(texts, 6 * words_at_once):
                words = [WORD.findall(x or "") for x in own]
                for w, runs in zip(words, find_runs(words)):
                    rows.append((len(w), [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], " ".join(collapsed(w, runs))))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    return found(text)


def longest(runs: Column) -> Column:
    """The run of greatest length; of several the first, then that of the smallest period; null without runs."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"), r.alias("r")))
    return F.array_min(ranked)["r"]
