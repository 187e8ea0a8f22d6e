"""N-gram Jaccard join: all links of at least a threshold between sets of word shingles, with Bayesian pruning of candidates.

1. Each text becomes its set of hashed 5-word shingles, and the low bytes of N_HASHES MinHash values. Texts of equal sets
   form a copy class, and go on as one.
2. Classes that agree in all bytes of a band are candidates. A bucket's pairs compare their bytes by STEP at a time; a pair is
   dropped once the posterior probability that its similarity reaches the threshold is below the tolerance. What is left of
   a bucket is told by a spanning forest, so that its rows grow with its members and not with their pairs.
3. Within the components of those forests all pairs are compared in the same way, and what is left is verified exactly on the
   shingle sets, which meet in blocks. Blocks return, for each class, the number of documents that it links to.
A bucket or component of any size is dealt in blocks of bounded size, each pair of blocks being one group: no pair is lost
and no task has to hold more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Recent, in_slices, joined_by_size, small_side, spare, written

N_HASHES, BAND, STEP = 128, 4, 16
N_BANDS = N_HASHES // BAND
SHINGLE = 5
#: Least members that a block of a bucket or of a component has on average, and most shingles that one of a component has.
BUCKET_BLOCK, SET_BLOCK, BLOCK_SHINGLES = 400, 200, 600_000
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _hash_functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(6).integers(0, 1 << 63, (2, N_HASHES), np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(29)


def word_hashes() -> Recent:
    return Recent(lambda word: xxhash.xxh64_intdigest(word.encode()))


def shingle_sets(texts: list[str | None], known: Recent) -> list[np.ndarray]:
    """The rising distinct 64-bit hashes of each text's runs of SHINGLE words, of all its words together where they are fewer; none for a text without words."""
    words = [WORD.findall(x or "") for x in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    short = (sizes > 0) & (sizes < SHINGLE)
    padded = np.where(short, SHINGLE, sizes)
    ends = np.cumsum(padded)
    flat = np.zeros(int(padded.sum()), np.uint64)
    place = np.repeat(ends - padded, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[place] = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    n = max(0, len(flat) - SHINGLE + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        mixed = _scrambled(mixed * _BASE + flat[k : n + k])
    return [np.unique(mixed[end - size : end - SHINGLE + 1]) if size else np.zeros(0, np.uint64) for end, size in zip(ends.tolist(), padded.tolist())]


def signature(shingles: np.ndarray) -> bytes:
    """A byte of each MinHash value."""
    multiply, add = _hash_functions()
    least = np.full(N_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * multiply + add).min(axis=0))
    return (least >> np.uint64(24)).astype(np.uint8).tobytes()


@cache
def needed_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For 0, STEP, 2 STEP, ... compared bytes, the least number that must agree: below it, P(similarity >= threshold) is under the tolerance, from a uniform prior. Bytes of different values agree once in 256."""
    similarity = (np.arange(4000) + 0.5) / 4000
    p = similarity + (1 - similarity) / 256
    reached = similarity >= threshold
    needed = [0]
    for n in range(STEP, N_HASHES + 1, STEP):
        for m in range(n + 1):
            like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p) - n * np.log(p).max())
            if like[reached].sum() >= tolerance * like.sum():
                break
        needed.append(m)
    return np.array(needed)


def likely(signatures: np.ndarray, a: np.ndarray, b: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) stay, compared STEP bytes at a time."""
    alive, agreed = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k in range(1, len(needed)):
        part = slice((k - 1) * STEP, k * STEP)
        agreed = agreed + (signatures[a[alive], part] == signatures[b[alive], part]).sum(axis=1)
        keep = agreed >= needed[k]
        alive, agreed = alive[keep], agreed[keep]
    return alive


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label[a] == label[b]).all():
            while (label != label[label]).any():
                label = label[label]
            break
    return label


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 4000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups, from batches that are sorted by the keys, and each row's group number in its frame."""
    held: list[pd.DataFrame] = []
    for batch in chain(batches, [None]):
        if batch is not None and len(batch):
            held.append(batch)
        if not held or batch is not None and sum(map(len, held)) < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        starts = np.r_[True, (frame[keys].to_numpy()[1:] != frame[keys].to_numpy()[:-1]).any(axis=1)]
        end = len(frame) if batch is None else np.flatnonzero(starts)[-1]
        held = [frame.iloc[end:]] if end < len(frame) else []
        if end:
            yield frame.iloc[:end], np.cumsum(starts[:end]) - 1


def pairs(group: np.ndarray, block: np.ndarray, crossing: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (a, b), a < b, of equal group, some at a time; where the group is of two blocks, only those across."""
    distance = 1
    while distance < len(group):
        a = np.flatnonzero(group[:-distance] == group[distance:])
        if not len(a):
            break
        b = a + distance
        ok = ~crossing[a] | (block[a] != block[b])
        yield a[ok], b[ok]
        distance += 1


def n_blocks(members: Column, least: int) -> Column:
    """In how many blocks a group is dealt: 50 at most, so that a row goes to as many tasks at most, until blocks have ten times their least members."""
    return members / F.least(F.greatest(members / 50, F.lit(least)), F.lit(10 * least))


def in_blocks(rows: DataFrame, group: str, blocks: Column, number: str) -> DataFrame:
    """Rows with _i, _j and _block: a group is dealt in so many blocks by a hash of the number, and each row goes to all pairs of blocks with its own in them."""
    dealt = rows.withColumn("_blocks", F.greatest(F.ceil(blocks), F.lit(1)).cast("int")).withColumn("_block", F.pmod(F.xxhash64(number), F.col("_blocks")).cast("int"))
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    out = other.withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other")).drop("_other", "_blocks")
    return out.repartition(group, "_i", "_j").sortWithinPartitions(group, "_i", "_j")


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(a, b, m): each of the total edges with the least of a and all its neighbours b. The centre of a large star doesn't bring its edges together in one task."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return joined_by_size(edges, least, "a", "n", total).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node's least reachable node, from edges (a, b). Large stars and small stars in turn, each a grouped minimum and a join, until a round changes nothing. Nodes without an edge to another are left out."""
    edges = written(edges.filter("a != b").distinct(), "edges")

    def digest(e: DataFrame):
        return e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()

    before = digest(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * before["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
        small = _with_least(down, before["n"])
        edges = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), "edges")
        now = digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _identity(doc_id: str, text: str) -> list[Column]:
    """Two hashes of a row's id and text, by which it is found again."""
    return [F.xxhash64(doc_id, text).alias("h1"), F.xxhash64(text, doc_id).alias("h2")]


def signed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, h1, h2, and key (of the shingle set; null without words), n, sig of each row; written."""

    @F.pandas_udf("key binary, n int, sig binary")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = word_hashes()
        for texts in batches:
            rows = []
            for own in in_slices(texts, 1_000_000):
                for s in shingle_sets(own, known):
                    rows.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), signature(s)) if len(s) else (None, 0, None))
            yield pd.DataFrame(rows, columns=["key", "n", "sig"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return written(rows.select("doc_id", *_identity("doc_id", "text"), sign("text").alias("s")).select("doc_id", "h1", "h2", "s.*"), "signed")


def _bucket_links(threshold: float, tolerance: float) -> Callable:
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        needed = needed_matches(threshold, tolerance)
        for frame, group in whole_groups(batches, ["bucket", "_i", "_j"]):
            signatures = np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(len(frame), N_HASHES)
            found = [], []
            for a, b in pairs(group, frame["_block"].to_numpy(), (frame["_i"] != frame["_j"]).to_numpy()):
                alive = likely(signatures, a, b, needed)
                found[0].append(a[alive])
                found[1].append(b[alive])
            if found[0]:
                label = forest(np.concatenate(found[0]), np.concatenate(found[1]), len(frame))
                at = np.flatnonzero(label != np.arange(len(frame)))
                number = frame["number"].to_numpy()
                yield pd.DataFrame({"a": number[at], "b": number[label[at]]}).drop_duplicates()

    return links


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections: one by one where they are few, else by products of slices of the incidence matrix of the sets at hand."""
    if len(a) < 4 * len(sets):
        return np.fromiter((len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)), np.int64, len(a))
    used = np.unique(np.r_[a, b])
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    _, column, counts = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(used), len(used)), np.float64)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [at, at + width])
        incidence = np.zeros((len(used), width), np.float32)
        incidence[owner[low:high], column[low:high] - at] = 1
        total += incidence @ incidence.T
    return total[place[a], place[b]].astype(np.int64)


def _verified(threshold: float, tolerance: float) -> Callable:
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        needed = needed_matches(threshold, tolerance)
        for frame, group in whole_groups(batches, ["component", "_i", "_j"], 400):
            signatures = np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(len(frame), N_HASHES)
            sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
            n = np.array([len(s) for s in sets], np.float64)
            number, size = frame["number"].to_numpy(), frame["size"].to_numpy()
            left: tuple[list, list] = [], []
            for a, b in pairs(group, frame["_block"].to_numpy(), (frame["_i"] != frame["_j"]).to_numpy()):
                close = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])
                a, b = a[close], b[close]
                alive = likely(signatures, a, b, needed)
                left[0].append(a[alive])
                left[1].append(b[alive])
            if not left[0]:
                continue
            a, b = np.concatenate(left[0]), np.concatenate(left[1])
            common = np.zeros(len(a), np.int64)
            order = np.argsort(group[a], kind="stable")
            edges = np.r_[np.flatnonzero(np.r_[True, np.diff(group[a][order]) > 0]), len(a)] if len(a) else np.zeros(1, int)
            for low, high in zip(edges[:-1], edges[1:]):
                own = order[low:high]
                start, end = np.searchsorted(group, [group[a[own[0]]], group[a[own[0]]] + 1])
                common[own] = _common(sets[start:end], a[own] - start, b[own] - start)
            linked = common >= threshold * (n[a] + n[b] - common) - 1e-9
            a, b = a[linked], b[linked]
            documents = np.bincount(a, size[b], len(frame)) + np.bincount(b, size[a], len(frame))
            at = np.flatnonzero(documents)
            label = forest(a, b, len(frame))
            yield pd.DataFrame({"number": number[at], "documents": documents[at].astype(np.int64), "least": number[label[at]]})

    return links


def join(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, h1, h2, copy_class_id (least doc_id of equal shingle sets), class_id (least doc_id of all that links lead to), n_links (other rows with at least the threshold's similarity), chosen (in the one row of its class that stands for it, or a repetition of that row), has_words.

    A row without words (null, empty or blank text) has no links and stands for itself. Rows of equal id and text are copies
    like any others. A class without any id has null as its class_id. A very long text is shingled whole, alone in its slice.
    An empty table gives no rows; extra columns are not looked at.
    """
    rows = signed(docs, id_col, text)
    identity = F.struct("doc_id", "h1", "h2")
    worded = rows.filter("key is not null")
    grouped = worded.groupBy("key").agg(F.min(identity).alias("first"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(grouped.withColumn("number", F.monotonically_increasing_id()), "classes")
    n_classes = classes.count()

    as_number = lambda k: F.conv(F.hex(F.substring("sig", k * BAND + 1, BAND)), 16, 10).cast("long") + F.shiftleft(k.cast("long"), 8 * BAND)
    bands = classes.select("number", F.explode(F.transform(F.sequence(F.lit(0), F.lit(N_BANDS - 1)), as_number)).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    candidates = joined_by_size(bands, shared, "bucket", "members", N_BANDS * n_classes).join(classes.select("number", "sig"), "number")
    forests = in_blocks(candidates, "bucket", n_blocks(F.col("members"), BUCKET_BLOCK), "number").mapInPandas(_bucket_links(threshold, tolerance), "a long, b long")
    component = components(forests).select(F.col("node").alias("number"), F.col("label").alias("component"))

    own = component.join(classes, "number").select("number", "component", "size", "n", "sig", "first.h1", "first.h2")
    sizes = own.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    members = written(joined_by_size(own, sizes, "component", "members", n_classes), "members")

    @F.pandas_udf("binary")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = word_hashes()
        for texts in batches:
            yield pd.Series([s.tobytes() for own in in_slices(texts, 1_000_000) for s in shingle_sets(own, known)], dtype=object)

    # members are found where their texts are read, so that no other text is shuffled
    texts = docs.select(*_identity(id_col, text), F.col(text).alias("text")).join(small_side(members.select("number", "h1", "h2")), ["h1", "h2"]).groupBy("number").agg(F.first("text").alias("text"))
    sets = members.join(texts, "number").select("number", "component", "members", F.col("shingles").alias("together"), "size", "sig", shingles("text").alias("shingles"))
    blocks = F.greatest(n_blocks(F.col("members"), SET_BLOCK), F.col("together") / BLOCK_SHINGLES)
    links = written(in_blocks(sets, "component", blocks, "number").mapInPandas(_verified(threshold, tolerance), "number long, documents long, least long"), "links")

    linked = links.groupBy("number").agg(F.sum("documents").alias("documents"))
    near = components(links.select(F.col("number").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "number")
    named = classes.select("number", "key", "size", "least_id", "first").join(linked, "number", "left").join(near, "number", "left")
    named = named.select("key", "size", "least_id", "first", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("label", "number").alias("label"))
    named = written(named, "named")
    heads = named.groupBy("label").agg(F.min("least_id").alias("class_id"), F.min("first").alias("chosen"), F.count(F.lit(1)).alias("n"))
    named = joined_by_size(named, heads, "label", "n", n_classes)
    named = written(named.select("key", "size", F.col("least_id").alias("copy_class_id"), "class_id", (F.col("size") - 1 + F.col("documents")).alias("n_links"), "chosen"), "named")
    out = joined_by_size(worded.select("key", "doc_id", "h1", "h2"), named, "key", "size", rows.count())
    is_chosen = (F.col("h1") == F.col("chosen.h1")) & (F.col("h2") == F.col("chosen.h2"))
    out = out.select("doc_id", "h1", "h2", "copy_class_id", "class_id", "n_links", is_chosen.alias("chosen"), F.lit(True).alias("has_words"))
    alone = rows.filter("key is null").select("doc_id", "h1", "h2", F.col("doc_id").alias("copy_class_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("chosen"), F.lit(False).alias("has_words"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near duplicates, all columns: that of the least id; of its repetitions an arbitrary one. Rows without words (null, empty or blank texts) all stay. An empty table stays empty; extra columns may have any name.

    Only rows that go, or that are repeated, are looked up by the hashes of id and text; all others stay where they are.
    """
    own, stays = [spare(f"_h{k}", docs.columns) for k in (1, 2)], spare("_stays", docs.columns)
    found = join(docs, threshold, tolerance, id_col, text).filter("has_words").groupBy("h1", "h2").agg(F.min("chosen").alias(stays), F.count(F.lit(1)).alias("n"))
    looked = written(found.filter(~F.col(stays) | (F.col("n") > 1)).select(F.col("h1").alias(own[0]), F.col("h2").alias(own[1]), stays), "dropped")
    marked = docs.withColumns(dict(zip(own, _identity(id_col, text)))).join(small_side(looked), own, "left")
    once = marked.filter(F.col(stays).isNull())
    repeated = marked.filter(F.col(stays)).dropDuplicates(own)
    return once.unionByName(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))
