"""Near-duplicate classes by min-max hashing.

1. Of each permutation both the least and the greatest value of a text's shingles are kept: N_HASHES values for half as many
   hash evaluations. The share of equal values is an unbiased estimate of the similarity, with a smaller variance than that of
   as many permutations, since an equal minimum makes an equal maximum a little less likely. A band holds minima alone or
   maxima alone, of different permutations each, and so agrees with probability similarity ** BAND.
2. Copies (equal sets) go on as one. Sets that agree in a band are candidates; those whose values agree too seldom for the
   threshold, by a binomial bound, are no link. What a bucket's members say is told as a forest.
3. In the components of those forests, links are confirmed on the full sets: the likeliest pairs first, and only such as lie in
   different components yet. Confirmed links give the classes.

A group of any size is dealt in blocks that a few of its members, the leaders, go with. Who is connected with the commonest
leader is done with; who isn't meets all blocks of the group. So a group of copies with small differences takes time in
proportion to its members, and no link is lost in any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_slices, joined_by_size, small_side, written
from .jaccard_join import _common as set_intersections
from .jaccard_join import _identity as identity
from .jaccard_join import components, forest, shingle_sets, whole_groups, word_hashes

N_PERMUTATIONS, BAND = 65, 5
N_HASHES = 2 * N_PERMUTATIONS
N_BANDS = N_HASHES // BAND
#: Members of a block, leaders that go with each block of a group of more, and most shingles that a block of sets has on average.
BLOCK, LEADERS, BLOCK_SHINGLES = 300, 6, 600_000


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(12).integers(0, 1 << 63, (2, N_PERMUTATIONS), np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def min_max(shingles: np.ndarray) -> bytes:
    """A byte of each permutation's least value, then one of each greatest."""
    multiply, add = _permutations()
    least, most = np.full(N_PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(N_PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 2048):
        values = shingles[at : at + 2048, None] * multiply + add
        least, most = np.minimum(least, values.min(axis=0)), np.maximum(most, values.max(axis=0))
    return (np.concatenate([least, most]) >> np.uint64(24)).astype(np.uint8).tobytes()


def folded(text: str | None) -> str:
    """The text with A to Z in lower case, and nothing else."""
    return (text or "").encode().lower().decode()


@cache
def least_agreeing(threshold: float, tolerance: float = 1e-9) -> int:
    """The least number of equal values that a pair of the threshold's similarity falls short of with at most the tolerance's probability."""
    p = threshold + (1 - threshold) / 256
    terms = np.ones(N_HASHES + 1)
    for k in range(N_HASHES):
        terms[k + 1] = terms[k] * (N_HASHES - k) / (k + 1) * p / (1 - p)
    return int(np.searchsorted(np.cumsum(terms) * (1 - p) ** N_HASHES, tolerance, "right"))


def similar_values(signatures: np.ndarray, needed: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values agree, for the pairs (a, b); 0 for fewer than needed."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), 20_000):
        own = slice(at, at + 20_000)
        out[own] = (signatures[a[own]] == signatures[b[own]]).sum(axis=1)
    return np.where(out >= needed, out, 0)


def _pairs(ours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of which at least one is ours."""
    a, b = np.triu_indices(len(ours), 1)
    own = ours[a] | ours[b]
    return a[own], b[own]


def by_signature(threshold: float) -> Callable[[pd.DataFrame, np.ndarray], np.ndarray]:
    """Labels of a group's members, linked by how many values agree."""
    needed = least_agreeing(threshold)

    def labels(group: pd.DataFrame, ours: np.ndarray) -> np.ndarray:
        signatures = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(len(group), N_HASHES)
        a, b = _pairs(ours)
        near = similar_values(signatures, needed, a, b) > 0
        return forest(a[near], b[near], len(group))

    return labels


def by_sets(percent: int) -> Callable[[pd.DataFrame, np.ndarray], np.ndarray]:
    """Labels of a group's members, linked by the similarity of their full sets. Pairs are confirmed in order of their estimates, some at a time, as long as they lie apart."""
    needed = least_agreeing(percent / 100)

    def labels(group: pd.DataFrame, ours: np.ndarray) -> np.ndarray:
        signatures = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(len(group), N_HASHES)
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        n = np.array([len(s) for s in sets], np.int64)
        a, b = _pairs(ours)
        near = similar_values(signatures, needed, a, b)
        possible = np.flatnonzero((near > 0) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])))
        order = possible[np.argsort(-near[possible], kind="stable")]
        a, b, label, at_once = a[order], b[order], np.arange(len(group)), 2 * len(group)
        while len(a):
            own, other = a[:at_once], b[:at_once]
            common = set_intersections(sets, own, other)
            linked = 100 * common >= percent * (n[own] + n[other] - common)
            joined = forest(label[own[linked]], label[other[linked]], len(group))
            label = joined[label]
            a, b = a[at_once:], b[at_once:]
            apart = label[a] != label[b]
            a, b, at_once = a[apart], b[apart], 2 * at_once
        return label

    return labels


def _labelled(labels: Callable) -> Callable:
    """Groups of (_group, _i, _j) to edges (_group, number, other, leader): the least member of each one's component, and the first leader in it (null for none)."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, group in whole_groups(batches, ["_group", "_i", "_j"], BLOCK):
            for start, end in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.r_[True, np.diff(group) > 0, True]))):
                own = frame.iloc[start:end].reset_index(drop=True)
                label = labels(own, own["_ours"].to_numpy())
                rank = np.where(own["_leader"].isna(), LEADERS, own["_leader"].fillna(0)).astype(np.int64)
                first = np.full(len(own), LEADERS)
                np.minimum.at(first, label, rank)
                number = own["number"].to_numpy()
                leader = pd.array(first[label], dtype="Int32")
                leader[first[label] == LEADERS] = pd.NA
                yield pd.DataFrame({"_group": own["_group"], "number": number, "other": number[label], "leader": leader})

    return told


def connected(members: DataFrame, labels: Callable, n_blocks: Column) -> DataFrame:
    """(a, b): edges that connect what the labels connect in each group of members (_group, number, and what labels need). n_blocks: in how many blocks a group is dealt.

    A group of one block is compared whole. Of a larger one, each block is compared within itself and with the leaders. Members
    whose component in their block holds the group's commonest leader are connected with each other by it. The others are
    compared with all members, block by block: they go to as many tasks as there are blocks, and the blocks to as many as the
    others fill.
    """
    told = "_group long, number long, other long, leader int"
    dealt = members.withColumn("_blocks", F.greatest(F.ceil(n_blocks), F.lit(1)).cast("int")).withColumn("_i", F.pmod(F.xxhash64("number"), F.col("_blocks")).cast("int"))
    large = dealt.filter("_blocks > 1")
    # the leaders: of LEADERS parts of a group, dealt by a hash, the member with the least hash
    part, draw = F.pmod(F.xxhash64("number", F.lit(1)), F.lit(LEADERS)).cast("int"), F.struct(F.xxhash64("number", F.lit(3)), F.col("number").alias("number"))
    leaders = written(large.groupBy("_group", part.alias("leader")).agg(F.min(draw).alias("d")).select("_group", "leader", "d.number"), "leaders")
    marked = dealt.join(small_side(leaders.withColumnRenamed("leader", "_leader")), ["_group", "number"], "left")
    # a leader goes to all blocks, its own among them
    everywhere = F.when(F.col("_leader").isNotNull(), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array("_i"))
    first = marked.withColumn("_i", F.explode(everywhere)).withColumn("_j", F.lit(0)).withColumn("_ours", F.lit(True))
    within = written(first.repartition("_group", "_i", "_j").sortWithinPartitions("_group", "_i", "_j").mapInPandas(_labelled(labels), told), "within")
    edges = within.filter("number != other").select(F.col("number").alias("a"), F.col("other").alias("b"))
    if not leaders.take(1):
        return edges
    led = within.join(small_side(leaders.select("_group").distinct()), "_group", "left_semi")
    counts = led.groupBy("_group", "leader").agg(F.count(F.lit(1)).alias("n")).filter("leader is not null")
    commonest = written(counts.groupBy("_group").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("commonest")), "commonest")
    apart = led.join(small_side(commonest), "_group").filter(~F.col("leader").eqNullSafe(F.col("commonest"))).select("_group", "number").distinct()
    apart = written(apart, "apart")
    n_apart = written(apart.groupBy("_group").agg(F.count(F.lit(1)).alias("_apart")), "n_apart")
    rest = large.join(small_side(n_apart), "_group").join(small_side(apart.withColumn("_ours", F.lit(True))), ["_group", "number"], "left").withColumn("_ours", F.coalesce("_ours", F.lit(False)))
    rest = rest.withColumn("_parts", F.ceil(F.col("_apart") / BLOCK).cast("int")).withColumn("_part", F.pmod(F.xxhash64("number", F.lit(2)), F.col("_parts")).cast("int"))
    # part j of those apart meets each block i; one that is apart also goes with the others of its part to each block
    ours = rest.filter("_ours").withColumn("_j", F.col("_part")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    theirs = rest.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).filter("not (_ours and _part = _j)").withColumn("_ours", F.lit(False))
    both = ours.unionByName(theirs).withColumn("_leader", F.lit(None).cast("int"))
    across = written(both.repartition("_group", "_i", "_j").sortWithinPartitions("_group", "_i", "_j").mapInPandas(_labelled(labels), told), "across")
    return edges.unionByName(across.filter("number != other").select(F.col("number").alias("a"), F.col("other").alias("b")))


def signed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, h1, h2, and key (of the shingle set; null without words), n, sig of each row; written."""

    @F.pandas_udf("key binary, n long, sig binary")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = word_hashes()
        for texts in batches:
            rows = []
            for own in in_slices(texts, 1_000_000):
                for s in shingle_sets([folded(x) for x in own], known):
                    rows.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), min_max(s)) if len(s) else (None, 0, None))
            yield pd.DataFrame(rows, columns=["key", "n", "sig"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return written(rows.select("doc_id", *identity("doc_id", "text"), sign("text").alias("s")).select("doc_id", "h1", "h2", "s.*"), "signed")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs: the size of its set of 5-word shingles, the least id that links of at least percent of similarity lead to, and whether it is that.

    A text with fewer words is one shingle; a row without words (null, empty or blank) has none, no links, and itself as its
    class. Equal sets are linked. Rows of equal ids share a result if their texts do; where the id is null the class is the least
    id reachable, or null, and kept is true for a class without any id only. A very long text is shingled whole, alone in its
    slice. An empty table gives no rows; extra columns aren't looked at.
    """
    rows = signed(docs, id_col, text)
    worded = rows.filter("key is not null")
    first = F.min(F.struct("doc_id", "h1", "h2"))
    grouped = worded.groupBy("key").agg(first.alias("first"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(grouped.withColumn("number", F.monotonically_increasing_id()), "classes")
    n_classes = classes.count()

    bucket = lambda k: F.xxhash64(k, F.substring("sig", k * BAND + 1, BAND))
    bands = classes.select("number", F.explode(F.transform(F.sequence(F.lit(0), F.lit(N_BANDS - 1)), bucket)).alias("_group"))
    shared = bands.groupBy("_group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    candidates = joined_by_size(bands, shared, "_group", "members", N_BANDS * n_classes).join(classes.select("number", "sig"), "number")
    maybe = connected(written(candidates, "candidates"), by_signature(percent / 100), F.col("members") / BLOCK)
    component = components(maybe).select(F.col("node").alias("number"), F.col("label").alias("_group"))

    own = component.join(classes, "number").select("_group", "number", "n", "sig", "first.h1", "first.h2")
    sizes = own.groupBy("_group").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("together"))
    members = written(joined_by_size(own, sizes, "_group", "members", n_classes), "members")

    @F.pandas_udf("binary")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = word_hashes()
        for texts in batches:
            yield pd.Series([s.tobytes() for own in in_slices(texts, 1_000_000) for s in shingle_sets([folded(x) for x in own], known)], dtype=object)

    # members are found where their texts are read, so that no other text is shuffled
    texts = docs.select(*identity(id_col, text), F.col(text).alias("text")).join(small_side(members.select("number", "h1", "h2")), ["h1", "h2"]).groupBy("number").agg(F.first("text").alias("text"))
    sets = members.join(texts, "number").select("_group", "number", "members", "together", "sig", shingles("text").alias("shingles"))
    links = connected(written(sets, "sets"), by_sets(percent), F.greatest(F.col("members") / BLOCK, F.col("together") / BLOCK_SHINGLES))

    near = components(links).withColumnRenamed("node", "number")
    named = written(classes.select("number", "key", "size", "least_id").join(near, "number", "left").withColumn("label", F.coalesce("label", "number")), "named")
    heads = named.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = written(joined_by_size(named, heads, "label", "n", n_classes).select("key", "size", "component_id"), "named")
    out = joined_by_size(worded.select("key", "doc_id", F.col("n").alias("n_shingles")), named, "key", "size", rows.count())
    alone = rows.filter("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = out.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
