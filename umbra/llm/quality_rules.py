"""Line-first cleaning with DataFrame functions only.

Rules judge each line by its punctuation, navigation marks and boilerplate phrases. Failing lines go; a
document that loses more than half of its word characters that way, or fails the base rules, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from umbra.llm.common import SPACE, WORD

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_KEPT_PERCENT = 50
#: Characters that prose has few of; a line fails where they are more than a tenth of it.
NOISE = r"[#*$%&|<>!~^=_{}\\]"
#: Two separators make a line a menu.
NAVIGATION = r"(?s)[|»›•].*[|»›•]"
#: Guillemets that quote, opening either way, separate nothing.
QUOTED = "«[^«»]*»|»[^«»]*«|‹[^‹›]*›|›[^‹›]*‹"
#: A line with more words than so many for each separator is no menu, one with more for each phrase no boilerplate.
WORDS_A_SEPARATOR, WORDS_A_PHRASE = 10, 40
#: A line of one or two words must end a sentence.
SENTENCE_END = r"""[.!?:;…]["'”’»)\]]*[\x20\x09-\x0D]*\z"""
BOILERPLATE = (
    r"(?i)(all rights reserved|licensed under|released under the [a-z]+ licen[sc]e|terms of (use|service)|privacy policy|cookie policy"
    r"|accept (all )?cookies|enable javascript|subscribe to our|click here|read more|sign up for|lorem ipsum)"
)


def line_fails(line: Column) -> Column:
    """True for a line that is noise, a menu, a stub or boilerplate; lines without a word never fail."""
    noisy = F.regexp_count(line, F.lit(NOISE)) * 10 > F.length(line)
    stub = ~line.rlike(SENTENCE_END) & ~line.rlike(f"{WORD}[{SPACE}]+{WORD}[{SPACE}]+{WORD}")
    words = F.regexp_count(line, F.lit(WORD))
    bare = F.regexp_replace(line, QUOTED, " ")
    menu = line.rlike(NAVIGATION) & bare.rlike(NAVIGATION) & (F.regexp_count(bare, F.lit("[|»›•]")) * WORDS_A_SEPARATOR >= words)
    plate = line.rlike(BOILERPLATE) & (F.regexp_count(line, F.lit(BOILERPLATE)) * WORDS_A_PHRASE >= words)
    return line.rlike(WORD) & (noisy | menu | stub | plate)


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long")


def score_rules(docs: DataFrame) -> DataFrame:
    """docs with the base counts, base_failed, kept, n_lines_removed and clean_text.

    A null text counts as an empty one and fails; its clean_text is empty. Each row is judged by itself, so rows
    that repeat an id or a text have equal results, and an empty table gives none. A text of any length is read
    whole. Other columns pass through; the names of the added columns win over columns of docs that have the same name.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "clean_text"]
    text, words = F.coalesce(F.col("text"), F.lit("")), F.col("__q_words")
    first = docs.drop(*added).withColumns({"__q_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "__q_lines": F.split(text, "\n", -1)})
    n = F.size(words)
    # (hash, word, next, next but one, place), sorted: equal windows are neighbours, and hashes settle nearly all comparisons
    place = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    triples = F.slice(F.arrays_zip(words, F.slice(words, 2, F.greatest(n, F.lit(1))), F.slice(words, 3, F.greatest(n, F.lit(1))), place), F.lit(1), F.greatest(n - 2, F.lit(0)))
    windows = F.transform(triples.cast("array<struct<a:string,b:string,c:string,i:int>>"), lambda t: F.struct(F.xxhash64(t.a, t.b, t.c).alias("h"), t.a.alias("a"), t.b.alias("b"), t.c.alias("c"), t.i.alias("i")))
    second = first.withColumns({
        "__q_sorted": F.sort_array(windows),
        "__q_full": F.filter("__q_lines", lambda line: line.rlike(WORD)),
        "__q_good": F.filter("__q_lines", lambda line: ~line_fails(line)),
    })
    s = F.col("__q_sorted")
    one = "struct<h:bigint,a:string,b:string,c:string,i:int>"
    pairs = F.arrays_zip(s, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1)))).cast(f"array<struct<x:{one},y:{one}>>")
    same = F.filter(pairs, lambda p: (p.x.h == p.y.h) & (p.x.a == p.y.a) & (p.x.b == p.y.b) & (p.x.c == p.y.c))
    covered = F.flatten(F.transform(same, lambda p: F.array(p.x.i, p.x.i + 1, p.x.i + 2, p.y.i, p.y.i + 1, p.y.i + 2)))
    third = second.withColumns({
        "n_words": n.cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__q_full") - F.size(F.array_distinct("__q_full"))).cast("long"),
        "n_repeat_words": F.size(F.array_distinct(covered)).cast("long"),
        "__q_clean": F.array_join("__q_good", "\n"), "__q_removed": (F.size("__q_lines") - F.size("__q_good")).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    enough = 100 * word_chars(F.col("__q_clean")) >= MIN_KEPT_PERCENT * F.col("word_chars")
    fourth = third.withColumns({"base_failed": failed, "kept": ~failed & enough, "n_lines_removed": F.col("__q_removed"), "clean_text": F.col("__q_clean")})
    return fourth.drop("__q_words", "__q_lines", "__q_sorted", "__q_full", "__q_good", "__q_clean", "__q_removed")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their failing lines removed; columns as in docs."""
    scored = score_rules(docs.select(F.struct("*").alias("__doc"), "text"))
    # through a generator, for a plain filter would be pushed below the scoring, which would then run twice
    verdict = scored.select("__doc", F.inline(F.array(F.struct(F.col("kept").alias("__kept"), F.col("clean_text").alias("__clean"))))).where("__kept")
    changed = {"text": F.col("__clean"), "n_chars": F.length("__clean").cast("long")}
    return verdict.select(*[changed.get(c, F.col("__doc")[c]).alias(c) for c in docs.columns])
