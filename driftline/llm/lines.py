"""Line-first cleaning by quality rules, in DataFrame operations only.

Each line is judged by itself for punctuation, navigation and boilerplate; failing lines
go, and a document that loses too much of its text that way goes as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.text import SPACE_RUN, SPACES, word_list

#: Phrases of page furniture and notices, in lower case.
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under|copyright \(c\)|©|terms of (use|service)|privacy policy|"
    r"cookie policy|use(s)? cookies|enable javascript|lorem ipsum|click here|subscribe to our|sign up for|log ?in to"
)
#: A line is a notice if it has such a phrase for every so many of its words, or fewer.
NOTICE_WORDS = 80
SYMBOLS = "[#*$%&|<>]"
#: A line fails if more than this share of its words carry a symbol, or end in '!!', or stand between bars.
NOISY_WORDS = 0.3
#: A document goes if less than this share of its words' characters is left.
LEAST_LEFT = 0.35
WINDOW = 5


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails a rule: boilerplate, navigation, punctuation."""

    def fails(n: Column) -> Column:
        boilerplate = line.rlike(BOILERPLATE) & (F.regexp_count(line, F.lit(BOILERPLATE)) * NOTICE_WORDS >= n)
        navigation = F.regexp_count(line, F.lit(r"[|»›·>]")) > F.lit(NOISY_WORDS) * n
        symbols = F.regexp_count(line, F.lit(r"[#*$%&<>{}\\]+")) > F.lit(NOISY_WORDS) * n
        shouting = F.regexp_count(line, F.lit(r"[!?]{2,}")) > F.lit(NOISY_WORDS) * n
        return navigation | symbols | shouting | boilerplate

    return bind(F.size(F.split(F.btrim(line, F.lit(SPACES)), SPACE_RUN)), fails)


def repeated_words(words: Column) -> Column:
    """How many words lie in a 5-word window that occurs twice or more in the list.

    Windows are compared by 64-bit hash within one text. Most texts repeat none, which a
    distinct count tells; else equal windows become neighbours by sorting, and the covered
    positions are counted in one pass, so that the work is n log n at any repetition.
    """

    def windows(ws: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1))
        return F.transform(at, lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(WINDOW)]))

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(ps: Column) -> Column:
            same = lambda j, k: F.get(ps, j)["h"] == F.get(ps, k)["h"]
            twins = F.filter(ps, lambda p, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
            return F.sort_array(F.transform(twins, lambda p: p["i"]))

        total = F.aggregate(
            bind(pairs, starts),
            F.struct(F.lit(0).alias("count"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["count"] + i + WINDOW - F.greatest(i, a["end"])).alias("count"), (i + WINDOW).alias("end")),
        )
        return total["count"]

    def count(hs: Column) -> Column:
        return F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(0)

    return F.when(F.size(words) < WINDOW, 0).otherwise(bind(windows(words), count))


def bind(value: Column, use) -> Column:
    """use(value), with value computed once per row although ``use`` refers to it in loops."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_left: float = LEAST_LEFT) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines, n_failed_lines, left_share, clean_text.

    Null is the empty text, with no words: base_failed. clean_text is the lines that pass,
    in order, blank ones included; left_share is the share of word characters in it, 1 if
    there are none. Other columns play no part; repeated rows are judged alike. No shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    parted = base.select("doc_id", "text", word_list(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")

    def chars(lines: Column) -> Column:
        return F.char_length(F.regexp_replace(F.array_join(lines, ""), SPACE_RUN, ""))

    def judged(ls: Column) -> Column:
        full = F.filter(ls, has_word)
        passed = F.filter(ls, lambda x: ~has_word(x) | ~line_fails(x))
        return bind(passed, lambda ps: F.struct(
            F.size(full).cast("long").alias("n_lines"),
            (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
            (F.size(ls) - F.size(ps)).cast("long").alias("n_failed_lines"),
            chars(ls).cast("long").alias("word_chars"), chars(ps).alias("left"), F.array_join(ps, "\n").alias("clean_text"),
        ))

    measured = parted.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bind(F.col("words"), repeated_words).cast("long").alias("n_repeat_words"),
        bind(F.col("lines"), judged).alias("j"),
    )
    left = F.when(F.col("word_chars") > 0, F.col("left") / F.col("word_chars")).otherwise(1.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.select("doc_id", "n_words", "n_symbols", "n_repeat_words", "j.*").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (left >= least_left)).alias("kept"),
        "n_lines", "n_failed_lines", left.alias("left_share"), "clean_text",
    )
