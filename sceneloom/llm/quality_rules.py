"""Quality rules: a table of thresholds compiled into one projection over the text.

Nothing but Spark's own expressions is evaluated. Measures are columns of one select;
a rule is a row of ``RULES``: measure, least value, largest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.common import packed

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Frequent function words of the languages of the corpus.
STOP_WORDS = ("the and of to in is that for with on as by it be are this from at or an a "
              "de la le les et des en un une que qui dans pour est sur au par du pas avec "
              "der die das und den von zu mit sich des auf ist nicht ein eine dem im "
              "el los las y del se por con una para es no lo su al como").split()

#: Thresholds by measure; null on a side: no bound there. A text that breaks one is not kept.
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 20, None),
    ("repeat_share", None, 0.30),
    ("symbol_ratio", None, 0.10),
    ("mean_word", 2.0, 14.0),
    ("stop_share", 0.04, None),
    ("dup_line_share", None, 0.5),
    ("letter_share", 0.65, None),
]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _covered(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more."""
    both = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.sort_array(F.transform(F.filter(F.zip_with(both, F.zip_with(
        F.concat(F.array(F.lit(None).cast("bigint")), both["h"]), F.concat(F.slice(both["h"], 2, F.size(both)), F.array(F.lit(None).cast("bigint"))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x, y: F.struct(x["i"].alias("i"), (x["h"].eqNullSafe(y["a"]) | x["h"].eqNullSafe(y["b"])).alias("t"))),
        lambda x: x["t"] & x["i"].isNotNull()), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(twice, start, lambda s, i: F.struct(
        (s["n"] + (i + WINDOW - F.greatest(s["end"], i))).cast("long").alias("n"), (i + WINDOW).alias("end")), lambda s: s["n"])


def measure(docs: DataFrame) -> DataFrame:
    """``_row`` and the measures of every row's whole text; a null text counts as empty.

    Words are runs of characters other than space and U+0009..U+000D. n_repeat_words
    counts the words in windows of eight words that occur twice or more in the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = packed(docs, _t=text, _w=F.filter(F.split(F.translate(text, SPACES[1:], " " * 5), " "), lambda w: w != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(_without(x, SPACES)) > 0)
    each = F.transform("_w", lambda w: F.xxhash64(w))
    rows = rows.select("_row", "_t", F.size("_w").cast("long").alias("n_words"), each.alias("_h"), lines.alias("_l"),
                       F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).alias("_stop"))
    windows = F.when(F.size("_h") > WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("_h") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("*", windows.alias("_g"))
    # most texts repeat no window at all: those are told by a set of the hashes
    repeated = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), _covered(F.col("_g"))).otherwise(F.lit(0).cast("long"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.length(_without(F.col("_t"), SPACES)).cast("long")
    rows = rows.select(
        "_row", "n_words", chars.alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"),
        (F.col("_stop") / n).alias("stop_share"), F.size("_l").alias("_lines"),
        F.length(F.regexp_replace("_t", "[\\p{P}\\p{S}\\p{N}\\s]+", "")).alias("_letters"))
    return rows.select(
        "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stop_share",
        (F.col("word_chars") / n).alias("mean_word"), (F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest("_lines", F.lit(1))).alias("dup_line_share"), (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("_letters") / F.greatest("word_chars", F.lit(1))).alias("letter_share"))


def verdict(rules: list[tuple[str, float | None, float | None]] = RULES) -> Column:
    """The table as one condition: true where every measure is within its bounds."""
    kept = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            kept = kept & (F.col(name) >= least)
        if most is not None:
            kept = kept & (F.col(name) <= most)
    return kept


def judge(docs: DataFrame, rules: list[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """``_row`` (the row as a struct), the measures, base_failed and kept.

    ``base_failed``: fewer than 20 words, or over 30 % of them in repeated windows of
    eight. ``kept``: not base_failed and every rule holds. Empty and null texts fail.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measure(docs).select("*", base.alias("base_failed"), (~base & verdict(rules)).alias("kept"))
