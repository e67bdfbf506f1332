"""Line-first cleaning: lines that fail a rule are removed, then texts that lost too much are rejected.

Everything is a column expression over one row, so the operator has no shuffle, and a long text or a hot source is
only as much work as its length. Words are runs of characters that are not white space (space and 0x09-0x0D).

Line rules (a line without words is dropped and costs nothing):

* punctuation: no closing mark at the end of a line of fewer than ``LEAST_WORDS`` words, or every third word with "!!";
* navigation: more than ``SYMBOL_SHARE`` symbols a word (menus, separators, mark-up remains);
* boilerplate: one of ``PHRASES``, or a line that starts with one word three times, or a line seen before in the text.

A null text and a text without words have no words and are not kept. Equal rows get equal results; other columns
pass through. Columns of the same names as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarframe.llm.shared import fixed

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CLOSING = ".!?\"'”’»。！？"
LEAST_WORDS = 8
SYMBOL_SHARE = 0.3
#: Share of word characters that a text must keep.
KEPT_SHARE = 0.5
PHRASES = ["javascript", "cookie policy", "privacy policy", "terms of use", "all rights reserved", "lorem ipsum"]


def split_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Texts without a repeated window are told by one hash set; in the others
    the windows are sorted, equal neighbours keep their places, and every place covers up to three words.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)
    hashed = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(hashed)


def covered(ranked: Column) -> Column:
    """Words covered by the windows that have an equal neighbour in ``ranked`` (hash and place, sorted)."""
    pairs = F.filter(
        F.zip_with(ranked, F.slice(ranked, 2, F.size(ranked)), lambda a, b: F.when(a["h"] == b["h"], F.struct(a["i"].alias("i"), b["i"].alias("j")))),
        lambda p: p.isNotNull(),
    )
    at = F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["i"], p["j"])))))
    steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def has_phrase(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for p in PHRASES:
        found = found | F.contains(low, F.lit(p))
    return found


def symbols(text: Column) -> Column:
    return F.size(F.split(text, f"[{SYMBOLS}]", -1)) - 1


def line_fails(line: Column, words: Column, earlier: Column, phrases: Column, marked: Column) -> Column:
    """Whether a line with words is removed.

    ``earlier`` says that the text had the same line before; ``phrases`` and ``marked`` whether the whole text has
    any boilerplate phrase, and any symbol or "!!", so that most texts skip those searches line by line.
    """
    n = F.size(words)
    closed = F.contains(F.lit(CLOSING), F.substring(F.btrim(line, F.lit(WHITE)), -1, 1))
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    return (
        ((n < LEAST_WORDS) & ~closed)
        | ((n > 2) & (F.get(words, 0) == F.get(words, 1)) & (F.get(words, 1) == F.get(words, 2)))
        | (marked & ((shouts * 3 >= n) | (symbols(line) > n * F.lit(SYMBOL_SHARE))))
        | (phrases & has_phrase(line)) | earlier
    )


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts, the text without failing lines (``clean_text``) and the verdicts.

    Columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), clean_text, lost_share (double,
    null without words), base_failed, kept.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    # One array of lines with their words; later steps refer to columns, so nothing is split twice.
    df = docs.withColumn("_lines", fixed(F.filter(
        F.transform(F.split(source, "\n", -1), lambda l: F.struct(l.alias("line"), split_words(l).alias("words"))),
        lambda x: F.size(x["words"]) > 0,
    )))
    df = df.withColumns({
        "_words": fixed(F.flatten("_lines.words")), "_texts": F.col("_lines.line"), "_phrases": has_phrase(source),
        "n_symbols": symbols(source).cast("bigint"), "_shouts": F.contains(source, F.lit("!!")),
    })
    df = df.withColumns({
        "_windows": fixed(repeated_words(F.col("_words"))),
        "n_dup_lines": (F.size("_texts") - F.size(F.array_distinct("_texts"))).cast("bigint"),
    })
    df = df.withColumn("_has", fixed(F.array(F.col("n_dup_lines") > 0, F.col("_phrases"), (F.col("n_symbols") > 0) | F.col("_shouts"))))
    has = [F.get("_has", k) for k in range(3)]
    repeats = F.size(F.array_distinct("_windows")) != F.size("_windows")
    df = df.withColumns({
        "_flagged": F.transform(
            "_lines",
            lambda x, i: F.struct(
                x["line"].alias("line"), F.length(F.array_join(x["words"], "")).alias("chars"),
                line_fails(
                    x["line"], x["words"], has[0] & (F.array_position("_texts", x["line"]) <= i), has[1], has[2],
                ).alias("fails"),
            ),
        ),
        "_ranked": F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    })
    df = df.withColumn("_good", F.filter("_flagged", lambda x: ~x["fails"]))
    count = lambda rows: F.aggregate(rows, F.lit(0).cast("bigint"), lambda s, x: s + x["chars"])
    df = df.withColumns({
        "n_words": fixed(F.size("_words").cast("bigint")),
        "word_chars": count(F.col("_flagged")),
        "n_repeat_words": F.when(F.col("_ranked").isNull(), F.lit(0)).otherwise(covered(F.col("_ranked"))).cast("bigint"),
        "clean_text": F.array_join("_good.line", "\n"),
        "_kept_chars": count(F.col("_good")),
    })
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    df = df.withColumns({
        "lost_share": F.when(F.col("word_chars") > 0, 1 - F.col("_kept_chars") / F.col("word_chars")),
        "kept": ~F.col("base_failed") & (F.col("_kept_chars") >= F.col("word_chars") * F.lit(KEPT_SHARE)),
    })
    return df.drop("_lines", "_words", "_texts", "_windows", "_phrases", "_shouts", "_has", "_flagged", "_ranked", "_good", "_kept_chars")
