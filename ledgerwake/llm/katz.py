"""Katz backoff language model: Good-Turing discounted n-gram counts and exactly normalised backoff weights.

Texts are tokenised once into blocks of some million tokens, written to the shared folder. The counts of each length of
n-gram are added up where a hash of the context deals them, stored there as a table in parts, and go back to the blocks:

    blocks -> distinct words -> counters of words -> table of words; their counts and numbers -> blocks
    blocks -> distinct n-grams, of a context that has a number -> counters -> table of n-grams; counts, numbers -> blocks
                                                                  -> table of contexts, with what their weight is made of

An n-gram's counter is chosen by its context, and by its last word too for contexts of more than SALT tokens, so that no
counter gets all of a frequent word. A block evaluates its tokens by recursion: an n-gram that was seen by its discounted
count, any other by the n-gram that is shorter by its first word, times the backoff weight of its context, which is joined
from the table of contexts. Model.score does the same for other texts, by joins with the stored tables.

A message goes from a block to a counter that it has n-grams for, so that there are no more of them than blocks times
counters, nor than blocks have distinct n-grams.

The last token of each text is END; the context of its first one is BEGIN. Words that no training text has are one unknown
word. Counts over MOST are discounted by SPARE of one count, so that every context keeps mass for what it hasn't seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Recent, spare, written

#: Counts up to this are discounted by Good-Turing.
MOST = 5
SPARE = 0.01
BLOCK_TOKENS = 1_000_000
TOKENS_A_COUNTER = 800_000
SALT = 4_000_000
END = np.uint64(0)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What blocks and counters tell each other, and tables (to: NO_ONE), about n-grams of a length.
MESSAGE = "to long, kind int, length int, sender long, payload binary, sums array<double>"
STATE, COUNTS, GRAMS, CONTEXTS, SUMS = range(5)
NO_ONE = -1
SEED = 9


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0, in as few bytes each as the largest needs, byte plane by byte plane."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    planes = values.astype(kind).view(np.uint8).reshape(len(values), kind.itemsize).T
    return bytes([kind.itemsize]) + zlib.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"u{data[0]}").ravel().astype(np.uint64)


def pack_all(*arrays: np.ndarray) -> bytes:
    parts = [pack(a) for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def unpack_all(data: bytes, n: int) -> list[np.ndarray]:
    ends = np.cumsum(np.frombuffer(data[: 8 * n], np.int64)) + 8 * n
    return [unpack(data[a:b]) for a, b in zip([8 * n, *ends[:-1].tolist()], ends.tolist())]


def rising(values: np.ndarray) -> np.ndarray:
    """The steps between sorted values, which pack better than they do."""
    return np.diff(values, prepend=values.dtype.type(0))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


@dataclass(frozen=True)
class Discounts:
    """d_r for counts r of 1 to MOST, from the numbers n_1 .. n_(MOST+1) of things that were counted so often; absolute discounting where Good-Turing's formula gives no number between 0 and 1."""

    ratio: tuple[float, ...]

    @classmethod
    def of(cls, n: list[float]) -> Discounts:
        absolute = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 else 0.5
        ratio = []
        for r in range(1, MOST + 1):
            d = 0.0
            if n[0] > 0 and n[r - 1] > 0:
                common = (MOST + 1) * n[MOST] / n[0]
                d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) if common < 1 else 0.0
            ratio.append(d if 0 < d < 1 else (r - absolute) / r)
        return cls(tuple(ratio))

    def kept(self, count: np.ndarray) -> np.ndarray:
        """The discounted counts; 0 for 0."""
        small = np.r_[0.0, np.array(self.ratio) * np.arange(1, MOST + 1)]
        return np.where(count <= MOST, small[np.minimum(count, MOST).astype(np.int64)], count - SPARE)


@dataclass(frozen=True)
class Singles:
    """The model of single words: tokens (N) and distinct ones (V) in training, the discounts, and the probability of the unknown word."""

    tokens: float
    distinct: float
    discounts: Discounts
    unknown: float

    @classmethod
    def of(cls, sums: list[float]) -> Singles:
        """sums: tokens, distinct, n_1 .. n_(MOST+1)."""
        tokens, distinct, n = sums[0], sums[1], sums[2:]
        discounts = Discounts.of(n)
        lost = sum((1 - d) * r * k for r, (d, k) in enumerate(zip(discounts.ratio, n), 1)) + SPARE * (distinct - sum(n[:MOST]))
        return cls(tokens, distinct, discounts, lost / tokens if tokens else 1.0)

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discounts.kept(count) / max(self.tokens, 1), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the word's share with one count added to each word and to the unknown one."""
        return np.log10((count + 1) / (self.tokens + self.distinct + 1))


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.translate(_LOWER).encode(), SEED) or 1


def _count_sums(count: np.ndarray) -> list[float]:
    seen = count[count > 0]
    return [float(seen.sum()), float(len(seen)), *np.bincount(np.minimum(seen, MOST + 2).astype(np.int64), minlength=MOST + 3)[1 : MOST + 2].astype(float)]


def _messages(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["to", "kind", "length", "sender", "payload", "sums"])


def tokenised(docs: DataFrame, trains: Column, id_col: str, text: str, block_tokens: int) -> DataFrame:
    """Blocks of whole texts, written: block, doc_id (array), sizes (tokens of each text), training (0 or 1 of each), words (the distinct hashes, rising), uses (of each in training), tokens (places in words), and the numbers of tokens and of training texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), trains.cast("int").alias("trains"))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Recent(_hash)
        ids, training, sizes, parts, total, number = [], [], [], [], 0, 0

        def block() -> pd.DataFrame:
            words, place = np.unique(np.concatenate(parts), return_inverse=True)
            used = np.repeat(np.array(training, np.float64), sizes)
            uses = np.bincount(place, used, len(words)).astype(np.int64)
            name = TaskContext.get().partitionId() << 24 | number
            return pd.DataFrame({
                "block": [name], "doc_id": [pd.array(ids, dtype=object)], "sizes": [pack(np.array(sizes))], "training": [pack(np.array(training))],
                "words": [pack(rising(words))], "uses": [pack(uses)], "tokens": [pack(place)], "n_tokens": [total], "n_training": [sum(training)],
            })

        for batch in batches:
            for doc_id, x, train in zip(batch["doc_id"], batch["text"], batch["trains"]):
                words = WORD.findall(x or "")
                hashes = np.empty(len(words) + 1, np.uint64)
                hashes[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                hashes[-1] = END
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                training.append(int(train))
                sizes.append(len(hashes))
                parts.append(hashes)
                total += len(hashes)
                if total >= block_tokens:
                    yield block()
                    ids, training, sizes, parts, total, number = [], [], [], [], 0, number + 1
        if ids:
            yield block()

    return written(rows.mapInPandas(blocks, "block long, doc_id array<long>, sizes binary, training binary, words binary, uses binary, tokens binary, n_tokens long, n_training long"), "blocks")


def _split(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each target that occurs, with the places where it does, in their order."""
    order = np.argsort(target, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(target[order]) > 0, True]).tolist() if len(target) else []
    for a, b in zip(edges, edges[1:]):
        yield int(target[order[a]]), order[a:b]


def _numbers(count: np.ndarray, counter: int, counters: int) -> np.ndarray:
    """A number for each thing counted here that no other counter gives; frequent things get low ones, which pack well."""
    number = np.empty(len(count), np.int64)
    number[np.argsort(-count, kind="stable")] = np.arange(len(count))
    return number * counters + counter


def count_words(blocks: DataFrame, counters: int) -> DataFrame:
    """To each block the number and the count in training of each of its words; to no one the table of words and the sums that the single-word model is made of. Written."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, packed, packed_uses in batch.itertuples(index=False):
                words, uses = np.cumsum(unpack(packed), dtype=np.uint64), unpack(packed_uses)
                yield _messages([(to, COUNTS, 1, block, pack_all(rising(words[at]), uses[at]), None) for to, at in _split((_spread(words) % np.uint64(counters)).astype(np.int64))])

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        counter = int(asked["to"].iloc[0])
        asked = asked.sort_values("sender")
        lists = [unpack_all(p, 2) for p in asked["payload"]]
        hashes = [np.cumsum(x, dtype=np.uint64) for x, _ in lists]
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        count = np.bincount(place, np.concatenate([u for _, u in lists]).astype(np.float64), len(words)).astype(np.int64)
        number = _numbers(count, counter, counters)
        ends = np.cumsum([len(h) for h in hashes]).tolist()
        rows = [(block, COUNTS, 1, counter, pack_all(number[place[a:b]], count[place[a:b]]), None) for block, a, b in zip(asked["sender"], [0, *ends[:-1]], ends)]
        seen = count > 0
        table = pack_all(rising(words[seen]), number[seen], count[seen])
        return _messages([*rows, (NO_ONE, GRAMS, 1, counter, table, None), (NO_ONE, SUMS, 1, counter, None, _count_sums(count))])

    asked = blocks.select("block", "words", "uses").mapInPandas(ask, MESSAGE)
    return written(asked.groupBy("to").applyInPandas(answer, MESSAGE), "word-counts")


def added_sums(messages: DataFrame, width: int) -> list[float]:
    """The sums of all counters, added up by Spark."""
    row = messages.filter(F.col("kind") == SUMS).select(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width))).first()
    return [float(v or 0) for v in row]


@dataclass
class Grams:
    """The distinct n-grams of one length in a block: which of them each token ends; what is known of each."""

    of: np.ndarray
    #: last word, context (BEGIN's is a place after all others) and the n-gram without its first word, as places in the block
    word: np.ndarray
    context: np.ndarray
    shorter: np.ndarray
    context_number: np.ndarray
    context_count: np.ndarray
    number: np.ndarray
    count: np.ndarray

    def counter(self, word_number: np.ndarray, counters: int) -> np.ndarray:
        """The counter of each n-gram."""
        salts = (self.context_count // SALT + 1).astype(np.uint64)
        salt = _spread(word_number[self.word].astype(np.uint64) + np.uint64(1)) % salts
        return (_spread(self.context_number.astype(np.uint64) * np.uint64(1 << 16) + salt + np.uint64(7)) % np.uint64(counters)).astype(np.int64)

    def asked(self, word_number: np.ndarray, counters: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each counter, with the places of its n-grams by context."""
        for to, at in _split(self.counter(word_number, counters)):
            yield to, at[np.argsort(self.context_number[at], kind="stable")]


class Block:
    """A block with what the counters answered for the lengths below the given one, and for that one too if it was counted."""

    def __init__(self, rows: pd.DataFrame, counters: int, length: int):
        self.number = int(rows["to"].iloc[0])
        state = rows[rows["kind"] == STATE]["payload"].iloc[0]
        packed_words, sizes, training, tokens = unpack_all(state, 4)
        self.sizes, self.training = sizes.astype(np.int64), training.astype(np.float32)
        words, place = np.cumsum(packed_words, dtype=np.uint64), tokens.astype(np.int32)
        del state, packed_words, tokens
        self.starts = np.cumsum(self.sizes) - self.sizes
        n, none = len(words), np.zeros(0, np.int64)
        self.grams = [Grams(place, np.arange(n), none, none, none, none, np.zeros(n, np.int64), np.zeros(n, np.int64))]
        self._take(rows, 1, _split((_spread(words) % np.uint64(counters)).astype(np.int64)))
        # as a context, BEGIN occurs as often as END
        self.texts = int(self.grams[0].count[words == END].sum())
        for k in range(2, length + 1):
            self.grams.append(self._longer())
            self._take(rows, k, self.grams[-1].asked(self.grams[0].number, counters))

    def _take(self, rows: pd.DataFrame, length: int, asked: Iterator[tuple[int, np.ndarray]]) -> None:
        own, answers = self.grams[-1], dict(rows[(rows["kind"] == COUNTS) & (rows["length"] == length)][["sender", "payload"]].itertuples(index=False))
        for counter, at in asked if answers else ():
            number, count = unpack_all(answers[counter], 2)
            own.count[at] = count.astype(np.int64)
            if len(number):
                own.number[at] = number.astype(np.int64)

    def _longer(self) -> Grams:
        last, n_words = self.grams[-1], len(self.grams[0].word)
        begin = len(last.count)
        gram = np.empty(len(last.of), np.int64)
        gram[0], gram[1:] = begin, last.of[:-1]
        gram[self.starts] = begin
        gram *= n_words
        gram += self.grams[0].of
        gram, of = np.unique(gram, return_inverse=True)
        context, shorter = gram // n_words, np.empty(len(gram), np.int64)
        shorter[of] = last.of
        number = np.r_[last.number + 1, 0][context]  # 0: BEGIN
        return Grams(of.astype(np.int32), gram % n_words, context, shorter, number, np.r_[last.count, self.texts][context], np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64))

    def uses(self) -> np.ndarray:
        """How often each of the longest n-grams occurs in training."""
        own = self.grams[-1]
        return np.bincount(own.of, np.repeat(self.training, self.sizes), len(own.count)).astype(np.int64)


def states(blocks: DataFrame) -> DataFrame:
    """The blocks as messages to themselves."""

    def state(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, *parts in batch.itertuples(index=False):
                head = np.array([len(p) for p in parts], np.int64).tobytes()
                yield _messages([(block, STATE, 0, block, head + b"".join(parts), None)])

    return blocks.select("block", "words", "sizes", "training", "tokens").mapInPandas(state, MESSAGE)


def _to_blocks(blocks: DataFrame, counted: list[DataFrame]) -> DataFrame:
    together = states(blocks)
    for messages in counted:
        together = together.unionByName(messages.filter(F.col("kind") == COUNTS))
    return together.groupBy("to")


def count_grams(blocks: DataFrame, counted: list[DataFrame], single: Singles, discounts: list[Discounts], counters: int, longest: bool) -> DataFrame:
    """To each block the counts of its n-grams of the next length, and their numbers if there are longer ones to come; to no one the table of n-grams, the parts of the contexts' backoff weights, and sums for the discounts. Written."""
    length = len(counted) + 1

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        b = Block(rows, counters, length)
        own, uses, word_number, below = b.grams[-1], b.uses(), b.grams[0].number, b.grams[-2]
        # what the probability of the n-gram without its first word is made of
        count, total = below.count[own.shorter], below.context_count[own.shorter] if length > 2 else np.zeros(0, np.int64)
        return _messages([
            (to, COUNTS, length, b.number, pack_all(rising(own.context_number[at]), word_number[own.word[at]], uses[at], count[at], total[at] if length > 2 else total), None)
            for to, at in own.asked(word_number, counters)
        ])

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        counter = int(asked["to"].iloc[0])
        asked = asked.sort_values("sender")
        lists = [unpack_all(p, 5) for p in asked["payload"]]
        contexts, context = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in lists]), return_inverse=True)
        words, word = np.unique(np.concatenate([x[1] for x in lists]), return_inverse=True)
        gram, first, place = np.unique(context.astype(np.int64) * len(words) + word, return_index=True, return_inverse=True)
        count = np.bincount(place, np.concatenate([x[2] for x in lists]).astype(np.float64), len(gram)).astype(np.int64)
        number = np.zeros(0, np.int64) if longest else _numbers(count, counter, counters)
        ends = np.cumsum([len(x[0]) for x in lists]).tolist()
        rows = [(block, COUNTS, length, counter, pack_all(number if longest else number[place[a:b]], count[place[a:b]]), None) for block, a, b in zip(asked["sender"], [0, *ends[:-1]], ends)]
        seen = count > 0
        below = np.concatenate([x[3] for x in lists])[first][seen].astype(np.int64)
        if length > 2:
            likely = discounts[-1].kept(below) / np.maximum(np.concatenate([x[4] for x in lists])[first][seen].astype(np.int64), 1)
        else:
            likely = single.probability(below)
        whose, count = (gram // len(words))[seen], count[seen]
        table = pack_all(rising(contexts[whose]), words[(gram % len(words))[seen]], count, number if longest else number[seen])
        parts = [np.bincount(whose[count == r], minlength=len(contexts)) for r in range(1, MOST + 1)]
        large = count > MOST
        parts += [np.bincount(whose[large], minlength=len(contexts)), np.bincount(whose[large], count[large], len(contexts))]
        weights = np.stack([contexts.astype(np.float64), *parts, np.bincount(whose, likely, len(contexts))])
        used = np.bincount(whose, minlength=len(contexts)) > 0
        packed = zlib.compress(np.ascontiguousarray(weights[:, used]).tobytes(), 1)
        return _messages([*rows, (NO_ONE, GRAMS, length, counter, table, None), (NO_ONE, CONTEXTS, length, counter, packed, None), (NO_ONE, SUMS, length, counter, None, _count_sums(count))])

    asked = _to_blocks(blocks, counted).applyInPandas(ask, MESSAGE)
    return written(asked.groupBy("to").applyInPandas(answer, MESSAGE), f"counts-{length}")


def backoff_weights(counted: DataFrame, discounts: Discounts) -> DataFrame:
    """(length, context, log_weight): log10 of the mass that the context's seen n-grams leave, over the mass that the shorter ones give to what it hasn't seen. A context that was dealt to several counters is added up first."""
    fields = ["context", *(f"n{r}" for r in range(1, MOST + 1)), "n_large", "large", "likely"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, payload in batch.itertuples(index=False):
                table = np.frombuffer(zlib.decompress(payload), np.float64).reshape(len(fields), -1)
                yield pd.DataFrame({"length": np.int32(length), **dict(zip(fields, table))}).astype({"context": np.int64})

    parts = counted.filter(F.col("kind") == CONTEXTS).select("length", "payload").mapInPandas(rows, "length int, " + ", ".join(f"{f} {'long' if f == 'context' else 'double'}" for f in fields))
    whole = parts.groupBy("length", "context").agg(*(F.sum(f).alias(f) for f in fields[1:]))
    total, kept = F.col("large"), F.col("large") - SPARE * F.col("n_large")
    for r, d in enumerate(discounts.ratio, 1):
        total, kept = total + r * F.col(f"n{r}"), kept + d * r * F.col(f"n{r}")
    return whole.select("length", "context", F.log10((1 - kept / total) / (1 - F.col("likely"))).alias("log_weight"))


SCORED = "block long, at int, length int, context long, n long, n_known long, base_score double, score double"


def evaluate(blocks: DataFrame, counted: list[DataFrame], single: Singles, discounts: list[Discounts], counters: int) -> DataFrame:
    """A row for each text (context null): block and place in it, n_tokens, n_known, base_score, and score without backoff weights; and a row for each text and context that it backs off from, n times. Written."""
    order = len(counted)

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        b = Block(rows, counters, order)
        n, owner, words = len(b.sizes), np.repeat(np.arange(len(b.sizes)), b.sizes), b.grams[0]
        base, known = (np.bincount(owner, x[words.of], n) for x in (single.base(words.count), (words.count > 0).astype(np.float64)))
        log_p, open_ = np.log10(single.probability(words.count))[words.of], np.ones(len(owner), bool)
        back = []
        for length in range(order, 1, -1):
            own = b.grams[length - 1]
            seen = (own.count > 0)[own.of] & open_
            log_gram = np.log10(np.maximum(discounts[length - 2].kept(own.count), 1e-300) / np.maximum(own.context_count, 1))
            log_p = np.where(seen, log_gram[own.of], log_p)
            open_ = open_ & ~seen
            # the contexts that each text backs off from, told apart by their places in the block
            off = open_ & (own.context_count > 0)[own.of]
            wide = len(b.grams[length - 2].count) + 1
            away, times = np.unique(owner[off] * wide + own.context[own.of[off]], return_counts=True)
            number = np.zeros(wide, np.int64)
            number[own.context] = own.context_number
            back.append((away // wide, np.full(len(away), length), number[away % wide], times))
        texts = pd.DataFrame({"at": np.arange(n), "length": 0, "context": pd.array([None] * n, "Int64"), "n": b.sizes, "n_known": known.astype(np.int64), "base_score": base, "score": np.bincount(owner, log_p, n)})
        parts = [pd.DataFrame({"at": at, "length": length, "context": pd.array(context, "Int64"), "n": times, "n_known": 0, "base_score": 0.0, "score": 0.0}) for at, length, context, times in back]
        out = pd.concat([texts, *parts], ignore_index=True)
        return out.assign(block=b.number)[[f.split()[0] for f in SCORED.split(", ")]]

    return written(_to_blocks(blocks, counted).applyInPandas(score, SCORED), "scores")


@dataclass
class Model:
    """A model as tables in the shared folder, a part for each counter: the n-grams that contexts of one counter have."""

    counted: list[DataFrame]
    single: Singles
    discounts: list[Discounts]
    texts: int

    def words(self) -> DataFrame:
        """(hash, number, n) of each word in training."""

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for payload in batch["payload"]:
                    hashes, number, count = unpack_all(payload, 3)
                    yield pd.DataFrame({"hash": np.cumsum(hashes, dtype=np.uint64).view(np.int64), "number": number.astype(np.int64), "n": count.astype(np.int64)})

        return self.counted[0].filter(F.col("kind") == GRAMS).select("payload").mapInPandas(rows, "hash long, number long, n long")

    def ngrams(self, length: int) -> DataFrame:
        """(context, word, n, number) of each n-gram in training: the number of its context, plus 1 (0: BEGIN), and of its last word; its own number is null in the longest ones."""

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for payload in batch["payload"]:
                    context, word, count, number = unpack_all(payload, 4)
                    numbers = pd.array(number.astype(np.int64) if len(number) else [None] * len(word), "Int64")
                    yield pd.DataFrame({"context": np.cumsum(context, dtype=np.uint64).view(np.int64), "word": word.astype(np.int64), "n": count.astype(np.int64), "number": numbers})

        return self.counted[length - 1].filter(F.col("kind") == GRAMS).select("payload").mapInPandas(rows, "context long, word long, n long, number long")

    def contexts(self) -> DataFrame:
        """(length, context, log_weight) of each context of n-grams of each length above 1."""
        out = None
        for counted, discounts in zip(self.counted[1:], self.discounts):
            own = backoff_weights(counted, discounts)
            out = own if out is None else out.unionByName(own)
        return out

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """docs with n_tokens and score, in place of columns of those names, by joins with the tables: each token is looked up at every length, and the recursion goes from the single word to the longest n-gram. For texts other than those of score(), which evaluates its own as it counts."""
        row = spare("_row", docs.columns)
        numbered = written(docs.drop("n_tokens", "score").withColumn(row, F.monotonically_increasing_id()), "to-score")

        @F.pandas_udf("array<long>")
        def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = Recent(_hash)
            for texts in batches:
                yield pd.Series([np.array([*map(known.__getitem__, WORD.findall(x or "")), int(END)], np.uint64).view(np.int64) for x in texts], dtype=object)

        def discounted(n, d):
            kept = n - SPARE
            for r, part in enumerate(d.ratio, 1):
                kept = F.when(n == r, part * r).otherwise(kept)
            return kept

        t = numbered.select(F.col(row).alias("row"), F.posexplode(hashes(F.col(text))).alias("at", "hash")).join(self.words(), "hash", "left").drop("hash")
        log_p = F.log10(F.when(F.col("n").isNotNull(), discounted(F.col("n"), self.single.discounts) / max(self.single.tokens, 1)).otherwise(self.single.unknown))
        t = t.select("row", "at", F.col("number").alias("word"), "number", "n", log_p.alias("log_p"))
        weights = self.contexts()
        for length, d in enumerate(self.discounts, 2):
            along, first = Window.partitionBy("row").orderBy("at"), F.col("at") == 0
            t = t.select("row", "at", "word", "log_p", F.when(first, F.lit(0)).otherwise(F.lag("number").over(along) + 1).alias("context"), F.when(first, F.lit(self.texts)).otherwise(F.lag("n").over(along)).alias("total"))
            t = t.join(self.ngrams(length), ["context", "word"], "left").join(weights.filter(F.col("length") == length).drop("length"), "context", "left")
            step = F.when(F.col("n").isNotNull(), F.log10(discounted(F.col("n"), d) / F.col("total"))).otherwise(F.col("log_p") + F.coalesce("log_weight", F.lit(0.0)))
            t = t.select("row", "at", "word", "number", "n", step.alias("log_p"))
        sums = t.groupBy(F.col("row").alias(row)).agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("log_p").alias("score"))
        return numbered.join(sums, row).drop(row)


def score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text: str = "text", order: int = 2, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, Model]:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row, by a model of n-grams of up to order words that is learned from the rows where trains is true; and that model.

    A null text is the empty one: END alone. A null in trains counts as false. Repeated rows and null ids count and are scored
    each; a very long text is in one block, whole. With no training row every token is the unknown word, of probability 1. An
    empty table gives no rows. Extra columns aren't looked at.
    """
    blocks = tokenised(docs, F.coalesce(trains, F.lit(False)), id_col, text, block_tokens)
    size = blocks.agg(F.sum("n_tokens"), F.sum("n_training")).first()
    counters = int(max(32, (size[0] or 0) // TOKENS_A_COUNTER))
    counted, discounts = [count_words(blocks, counters)], []
    single = Singles.of(added_sums(counted[0], MOST + 3))
    for length in range(2, order + 1):
        counted.append(count_grams(blocks, counted, single, discounts, counters, length == order))
        discounts.append(Discounts.of(added_sums(counted[-1], MOST + 3)[2:]))
    scores = evaluate(blocks, counted, single, discounts, counters)
    model = Model(counted, single, discounts, int(size[1] or 0))
    whole = scores.filter("context is null").drop("context", "length")
    if order > 1:
        backed = scores.filter("context is not null").select("block", "at", "length", "context", F.col("n").alias("times")).join(model.contexts(), ["length", "context"])
        backed = backed.groupBy("block", "at").agg(F.sum(F.col("times") * F.col("log_weight")).alias("backed"))
        whole = whole.join(backed, ["block", "at"], "left")
    else:
        whole = whole.withColumn("backed", F.lit(0.0))
    ids = blocks.select("block", F.posexplode("doc_id").alias("at", "doc_id"))
    whole = whole.join(ids, ["block", "at"])
    total = F.col("score") + F.coalesce("backed", F.lit(0.0))
    return whole.select("doc_id", F.col("n").alias("n_tokens"), "n_known", F.lit(int(single.tokens)).cast("long").alias("train_tokens"), "base_score", total.alias("score")), model
