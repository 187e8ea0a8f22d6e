"""Document fingerprints by one-permutation MinHash; DataFrame functions only.

Each shingle of five words is hashed once. The upper bits of the hash choose one of N_BINS bins, which keeps the least hash
it gets. An empty bin borrows from the filled bin that comes first in its own pseudo-random order of all bins, which is the
choice of optimal densification. Of each bin the low BITS bits are stored, and likeness corrects for their chance agreement.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, small_side, spare, written

BIN_BITS = 7
N_BINS = 1 << BIN_BITS
BITS = 8
SHINGLE = 5
_SEED = 8


def bound_to(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _shingles(words: Column) -> Column:
    """Hashes of all runs of SHINGLE words, or of all words where they are fewer; none without a word."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE)), F.lit(_SEED)))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def _filled(hashes: Column) -> Column:
    """The least hash of each bin that has one: sorting brings those of a bin together."""
    return bound_to(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))


def _densified(least: Column) -> Column:
    """The hash of every bin. Bin j asks the bins (odd_j * a + add_j) mod N_BINS for a = 0, 1, ...; the first filled one is that of the least a, found by inverting the map."""

    def borrow(j: Column, bins: Column) -> Column:
        add = F.pmod(F.hash(j, F.lit(1)), F.lit(N_BINS))
        inverse = F.pmod(F.hash(j, F.lit(2)), F.lit(N_BINS // 2)) * 2 + 1
        turn = lambda b: F.pmod((b - add) * inverse, F.lit(N_BINS)) * N_BINS + b
        return F.pmod(F.array_min(F.transform(bins, turn)), F.lit(N_BINS))

    def with_bins(bins: Column) -> Column:
        def value(j: Column) -> Column:
            own = F.array_position(bins, j)
            donor = F.when(own > 0, own).otherwise(F.array_position(bins, borrow(j, bins)))
            return F.get(least, (donor - 1).cast("int"))

        return F.transform(F.sequence(F.lit(0), F.lit(N_BINS - 1)), value)

    return bound_to(F.transform(least, _bin), with_bins)


def fingerprint(text: Column) -> Column:
    """The packed bins of a whole text, one byte each, less 128; an empty array where it has no word. A null text counts as empty."""
    low = lambda h: (F.pmod(h, F.lit(1 << BITS)) - (1 << (BITS - 1))).cast("tinyint")
    none = F.array().cast("array<tinyint>")
    packed = lambda words: F.when(F.size(words) == 0, none).otherwise(bound_to(_filled(_shingles(words)), lambda least: F.transform(_densified(least), low)))
    return bound_to(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_SQL), F.lit(0)), packed)


def hex_form(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda b: F.lower(F.lpad(F.hex(b.cast("long") + 128), 2, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints: the share of equal bins, corrected for those that agree by chance. Two texts without words are alike, and like no other text."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)).cast("double")
    chance = 1.0 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (equal / N_BINS - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(estimate)


def _ranges(docs: DataFrame, id_col: str, tie: Column, rows_each: int, most: int) -> Column:
    """A column that numbers ranges of rising ids, and of falling ties of one id, of about rows_each rows: a long that rises with them, null ids first.

    Quantiles of the ids, most at most, are a literal that is searched in halves. Beyond so many ranges each is cut into equal
    stretches of ids; ids that several quantiles fall on, and null, are cut by the tie, a number of 32 bits.
    """
    id_ = F.col(id_col).cast("long")
    state = docs.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("n_known"), F.min(id_).alias("least")).first()
    cut = lambda parts: parts - 1 - F.shiftright(tie * parts, 32)
    of_null = cut(F.lit((state["n"] - state["n_known"]) // rows_each + 1).cast("long"))
    if not state["n_known"]:
        return of_null
    wanted = state["n_known"] // rows_each + 1
    n, stretches = min(most, wanted), -(-wanted // most)
    quantiles = docs.agg(F.percentile_approx(id_, [k / n for k in range(1, n + 1)], 100 * n)).first()[0]
    times = Counter(quantiles)
    bounds = sorted(times)
    held = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    highs, lows, parts = held(bounds), held([state["least"], *bounds]), held([*((times[b] - 1) * stretches + 1 for b in bounds), 1])
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    at = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(highs, at + step - 1) < id_, at + step).otherwise(at))

    def within(at: Column) -> Column:
        low, high = F.get(lows, at).cast("double"), F.get(highs, at).cast("double")
        stretch = F.least(F.floor((id_ - low) / F.greatest(high - low, F.lit(1.0)) * stretches), F.lit(stretches - 1))
        inside = F.when(F.get(highs, at) == id_, stretches + cut(F.get(parts, at))).otherwise(F.coalesce(stretch, F.lit(0)))
        return (at + 1).cast("long") * (1 << 40) + inside.cast("long")

    return F.when(id_.isNull(), of_null).otherwise(bound_to(at, within))


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column] | None = None, id_col: str = "doc_id", rows_each: int = 1000, most: int = 1 << 14) -> DataFrame:
    """docs with the derived columns, made from the columns, and with next_<name> for columns and derived ones alike: their values in the row after it by descending id (null ids last), in the first row after the last. Equal ids go by the upper 32 bits of the columns' xxhash64, unsigned, then by the columns in turn.

    Rows are dealt by ranges of ids, and of hashes where one id has many rows, and followed within each range by a window; the
    ranges grow in number and not in rows. A range's last row is followed by the first of the next range that has rows: the
    numbers of those ranges alone are ordered in one task, and the first rows are joined by them. A single row is followed by
    itself; an empty table stays empty. Repeated rows follow each other; a very long text is handed on whole. An extra column
    called next_<name> gives way, others may have any name.
    """
    derived = derived or {}
    names = [*columns, *derived]
    own = {k: spare(f"_{k}", [*docs.columns, *names]) for k in ("range", "tie", "r", "high", "head", "inside", "n", "next")}
    following = {c: f"next_{c}" for c in names}
    after, inner = ({c: spare(f"_{what}_{c}", docs.columns) for c in names} for what in ("after", "inside"))
    tie = F.shiftrightunsigned(F.xxhash64(*columns), 32)
    dealt = docs.withColumn(own["tie"], tie).withColumn(own["range"], _ranges(docs, id_col, F.col(own["tie"]), rows_each, most))
    highest = small_side(written(dealt.groupBy(F.col(own["range"]).alias(own["r"])).agg(F.max(id_col).alias(own["high"])), "range-ids"))
    heads = dealt.join(highest, (F.col(own["range"]) == F.col(own["r"])) & F.col(id_col).eqNullSafe(F.col(own["high"])))
    heads = heads.groupBy(own["range"]).agg(F.min(F.struct(own["tie"], *columns)).alias(own["head"])).select(own["range"], *(F.col(f"{own['head']}.{c}").alias(c) for c in columns)).withColumns(derived)
    heads = written(heads.select(F.col(own["range"]).alias(own["n"]), *(F.col(c).alias(after[c]) for c in names)), "range-heads")
    falling = Window.partitionBy(F.lit(0)).orderBy(F.desc(own["n"]))
    order = heads.select(F.col(own["n"]).alias(own["range"]), F.coalesce(F.lead(own["n"]).over(falling), F.first(own["n"]).over(falling)).alias(own["next"]))
    heads = order.join(heads, F.col(own["next"]) == F.col(own["n"])).drop(own["n"], own["next"])
    inside = Window.partitionBy(own["range"]).orderBy(F.col(id_col).desc_nulls_last(), own["tie"], *(F.col(c).asc_nulls_first() for c in columns))
    followed = dealt.withColumns(derived).select("*", *(F.lead(c).over(inside).alias(inner[c]) for c in names), F.lead(F.lit(True)).over(inside).alias(own["inside"]))
    joined = followed.join(heads, own["range"], "left")
    kept = [c for c in [*docs.columns, *derived] if c.lower() not in {x.lower() for x in following.values()}]
    return joined.select(*(F.col(f"`{c}`") for c in kept), *(F.when(F.col(own["inside"]), F.col(inner[c])).otherwise(F.col(after[c])).alias(following[c]) for c in names))


def edited_text(text: Column, following: Column, n_chars: Column) -> Column:
    """The text with its last third replaced by as many first code points of the following one, or all of it."""
    third = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars - third), F.substring(following, F.lit(1), third))
