"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table.

All give one row for each row of their table (op10_mixing: for each copy), repeated rows and rows of null ids among them, and
none for an empty table. Texts are read whole, however long. Extra columns, whatever their names, change nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fill_in_middle, fingerprint, jaccard_join, katz, language_id, minmax_dedup, mixing, periodic_runs, pii, quality_classifier, repetition, warc
from .common import WORD_SQL, crc_mod, table

BPE_FILE = "byte_bpe_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids, digest of the ids and of what they decode to. A null text counts as empty: no ids."""
    digests = byte_bpe.round_trip(spark, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return table(spark, sf_dir, "documents").select("doc_id", digests("text").alias("t")).select("doc_id", "t.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and rule, and the verdict of the maximal repeats. A null or empty text has no words and fails the base rule."""
    r = F.col("r")
    measured = table(spark, sf_dir, "documents").select("doc_id", repetition.repetition_column(F.col("text")).alias("r"))
    failed = repetition.base_failed(r)
    return measured.select(
        "doc_id", "r.n_words", "r.word_chars", "r.n_symbols", "r.n_dup_lines", "r.n_repeat_words", failed.alias("base_failed"),
        (~failed & repetition.repeats_within(r)).alias("kept"), "r.n_repeats", "r.longest_repeat", "r.covered_chars",
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back from its own gzip member. A null html is an empty payload; of pages with equal payloads and the least page_id, all are responses."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of those that aren't held out. Null, empty and letterless texts are und, at score 0; of languages that tie the first by name is taken. A null doc_id counts as the empty text for the split; with nothing to learn from all are und."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.filter(~held_out))
    named = docs.select("doc_id", held_out.alias("held_out"), language_id.predict_column(F.col("text"), model, spark).alias("p"))
    return named.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.ambiguous")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail chances of every document, and whether it reaches the cut. A null or empty text is graded by the thresholds alone. A document that is rated twice counts twice if the grades differ, else once; one with a null id never; without ratings that tell anything apart all are kept."""
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", quality_classifier.grade_column().alias("grade"))
    model, cut = quality_classifier.fit(docs, ratings)
    graded = docs.select("doc_id", quality_classifier.grade_chances(F.col("text"), model, spark).alias("g"))
    top = F.col("g.tail")[1]
    return graded.select("doc_id", "g.expected_grade", F.col("g.tail")[0].alias("p_not_poor"), top.alias("p_good"), (top >= cut).alias("kept"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates and the number of links of every document. One without words stands alone; equal texts are copies, whatever their ids."""
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "copy_class_id", "class_id", "n_links", "chosen")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of personal data in every document. A null or empty text has none."""
    s = F.col("s")
    found = table(spark, sf_dir, "documents").select("doc_id", pii.span_column(F.col("text")).alias("s"))
    count = {kind: F.size(F.filter(s.kind, F.lit(kind).eqNullSafe)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS}
    return found.select(
        "doc_id", *(count[k] for k in pii.BASE_KINDS), F.sha2(pii.spans_digest(s, pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.spans_digest(s, pii.KINDS).alias("spans"), F.size(s).cast("long").alias("n_spans"), *(count[k] for k in pii.KINDS if k not in pii.BASE_KINDS),
    )


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness. A null text counts as empty. Equal ids, and null ones, which come last, are ordered by hashes of their texts, and by the texts where those are equal; a single row is the next one of itself."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    pairs = fingerprint.with_next(docs, ["text"], {"fp": fingerprint.fingerprint(F.col("text"))}).withColumn("n", F.char_length("text"))
    edited = pairs.select("doc_id", "n", "fp", "next_fp", fingerprint.edited_text(F.col("text"), F.col("next_text"), F.col("n")).alias("edited"))
    marked = edited.withColumn("edited_fp", fingerprint.fingerprint(F.col("edited")))
    return marked.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint.hex_form(F.col("fp")).alias("fingerprint"), fingerprint.hex_form(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), fingerprint.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every document by a model of those that aren't held out. A null or empty text is one end. A null doc_id counts as the empty text for the split; with nothing to learn from all scores are 0."""
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    scored, _ = katz.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("score_per_token"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as it was drawn for sources of even weight, shuffled. Rows of equal ids draw alike, null ids like the empty text; a source of null and empty texts alone goes."""
    return mixing.mix(table(spark, sf_dir, "documents"), copy_col="copy_no")


def _with_tail_repeated(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a document in ten, told by its id, the words from some place on are those of a stretch that repeats."""
    own = F.expr(f"regexp_extract_all(text, '{WORD_SQL}', 0)".replace("\\", "\\\\"))
    h, n = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.size(own)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(own, a + 1, period), F.ceil((n - a) / period).cast("int")))
    repeated = F.array_join(F.concat(F.slice(own, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, one in ten of them with a repeated tail, and what is left of it without the repetitions. A null or empty text has no runs; a null doc_id counts as the empty text for the draw."""
    r, one = F.col("r"), F.col("longest")
    found = _with_tail_repeated(table(spark, sf_dir, "documents")).select("doc_id", periodic_runs.runs_column(F.col("text")).alias("r"))
    lines = F.array_join(F.transform(r.runs, lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string"))), "\n")
    told = F.when(F.size(r.runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("longest", periodic_runs.longest(r.runs)).select(
        "doc_id", F.size(r.runs).cast("long").alias("n_runs"), one.start.alias("start"), one.length.alias("length"), one.period.alias("period"),
        F.floor(1000 * one.length / one.period).cast("long").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2(r.collapsed, 256).alias("collapsed_sha256"), r.n_words.alias("n_words"),
    )


def op12_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of every document's set of shingles, and the class that links of 85 % lead to. One without words stands alone."""
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as its fill-in-middle form, and the text read back out of it. A null or empty text is plain; a null doc_id draws like the empty text."""
    return fill_in_middle.transform(table(spark, sf_dir, "documents"), with_output=False)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_quality_rules, op3_warc, op4_language_id, op5_quality_classifier, op6_jaccard_join, op7_pii, op8_fingerprint, op9_katz, op10_mixing, op11_periodic_runs, op12_minmax_dedup, op13_fill_in_middle)}

ORACLE_SQL = {
    "op10_mixing": """
        WITH amounts AS (
            SELECT source, sum(coalesce(length(text), 0)) AS chars FROM documents GROUP BY source
        ), weighed AS (
            SELECT source, chars, CASE WHEN chars > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM amounts
        ), rates AS (
            SELECT source, CASE WHEN chars > 0 THEN weight / sum(weight) OVER () * CAST(sum(chars) OVER () AS DOUBLE) / chars ELSE 0.0 END AS rate FROM weighed
        ), terms AS (
            SELECT source, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) WHEN k = 0 THEN 1.0 ELSE 0.0 END AS p
            FROM rates, range(0, (SELECT CAST(ceil(coalesce(max(rate), 0) + 12 * sqrt(coalesce(max(rate), 0)) + 21) AS BIGINT) FROM rates)) AS t(k)
        ), cdf AS (
            SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
        ), drawn AS (
            SELECT d.*, CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
            FROM documents d
        ), counted AS (
            SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(c.k) AS n
            FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u
            GROUP BY ALL
        )
        SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy_no FROM counted
    """,
    "op13_fill_in_middle": """
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
        ), units AS (
            SELECT *, list_transform(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS sizes,
                list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(digest, k, 8) AS BIGINT)) AS h
            FROM drawn
        ), placed AS (
            SELECT *, len(sizes) AS n, least(h[1] % (len(sizes) + 1), h[2] % (len(sizes) + 1)) AS a, greatest(h[1] % (len(sizes) + 1), h[2] % (len(sizes) + 1)) AS b,
                CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM units
        ), measured AS (
            SELECT *, CASE WHEN form <> 'plain' THEN CAST(coalesce(list_sum(sizes[1:a]), 0) AS BIGINT) END AS prefix_chars,
                CASE WHEN form <> 'plain' THEN CAST(coalesce(list_sum(sizes[a + 1:b]), 0) AS BIGINT) END AS middle_chars
            FROM placed
        ), parts AS (
            SELECT *, substr(text, 1, prefix_chars) AS prefix, substr(text, prefix_chars + 1, middle_chars) AS middle, substr(text, prefix_chars + middle_chars + 1) AS suffix FROM measured
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, prefix_chars, middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM parts
    """,
}
