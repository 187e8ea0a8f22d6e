import random
import re
import time

from pyspark.sql import functions as F

from ledgerwake.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen, inside = {}, [False] * len(words)
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            for i in starts:
                inside[i : i + 5] = [True] * 5
    longest = 0
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            k = 0
            while j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)] if text and "\n" in text else []
    return len(words), sum(map(len, words)), len(lines) - len(set(lines)), sum(inside), longest if longest >= 5 else 0


def test_equals_brute_force():
    draw = random.Random(2)
    texts = [None, "", " \n\t", "a", "a a a a a a a a", "x\nx\n\nx y\nx"]
    texts += [" ".join(draw.choice("abc") for _ in range(draw.randrange(1, 60))) for _ in range(60)]
    texts += ["\n".join(draw.choice(("one two three four five six", "b c", "")) for _ in range(8)) for _ in range(20)]
    for text, got in zip(texts, repetition.measure(texts)):
        assert (got["n_words"], got["word_chars"], got["n_dup_lines"], got["n_repeat_words"], got["longest_repeat"]) == brute(text), text


def test_column(docs_of):
    docs = docs_of([None, "w " * 60_000, "one two three"]).withColumn("r", F.lit("clash"))
    rows = docs.select("doc_id", repetition.repetition_column(F.col("text")).alias("m")).withColumn("bad", repetition.base_failed(F.col("m"))).orderBy("doc_id").collect()
    assert [(r.m.n_words, r.bad) for r in rows] == [(0, True), (60_000, True), (3, True)]
    assert rows[1].m.longest_repeat == 59_999


def test_time_is_linear_in_one_repeated_word():
    start = time.time()
    got = repetition.measure(["word " * 300_000])[0]
    assert got["longest_repeat"] == 299_999 and got["n_repeat_words"] == 300_000 and time.time() - start < 20


def test_blanks_do_not_count(docs_of):
    """A text with long blanks is judged like the same text with single ones."""
    passage = [f"p{k}" for k in range(5)]
    words = [f"w{k}" for k in range(150)] + passage + [f"x{k}" for k in range(151)] + passage
    texts = [" ".join(words), (" " * 200).join(words), "\n\t".join(words), " ".join(passage * 2 + ["end"])]
    plain, *spread, short = repetition.measure(texts)
    for own in spread:
        assert {k: own[k] for k in own if k not in ("spans", "n_dup_lines")} == {k: plain[k] for k in plain if k not in ("spans", "n_dup_lines")}
    assert plain["covered_chars"] == 20 and short["covered_chars"] == 20 <= short["word_chars"]
    rows = docs_of(texts).select("doc_id", repetition.repetition_column(F.col("text")).alias("m")).select("doc_id", repetition.repeats_within(F.col("m")).alias("kept")).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True, True, True, False]
