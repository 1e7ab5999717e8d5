"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``measures`` computes counts of words, characters, symbols, stop words and lines for each text; ``RULES`` says
which values a good text has; ``apply_rules`` turns the table into columns. Nothing is shuffled.

Defined cases. Null text: no words, every count 0, base failed, not kept. Empty text: the same. Ratios over nothing are 0.
Repeated rows and null ids: one result row each. No rows: no rows. Columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but these.
WHITE = r"[\x20\x09-\x0D]"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window of the repetition measure.
WINDOW = 8

# Frequent function words by language.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "was", "for", "on", "by",
    "der", "die", "das", "und", "ist", "nicht", "mit", "von", "ein", "eine", "zu", "den", "im",
    "le", "la", "les", "de", "et", "un", "une", "que", "est", "pour", "dans", "sur", "pas",
    "el", "los", "las", "del", "que", "una", "por", "con", "para", "en", "al", "no", "se", "lo",
)


class Rule(NamedTuple):
    """A kept text has ``least <= measure <= most``; None is no limit."""

    measure: str
    least: float | None
    most: float | None


RULES: tuple[Rule, ...] = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("stop_ratio", 0.03, None),
    Rule("shout_ratio", None, 0.5),
    Rule("dup_line_ratio", None, 0.45),
    Rule("bar_line_ratio", None, 0.3),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more, from the hashes of a text's words."""
    starts = F.sequence(F.lit(0), F.size(hashes) - F.lit(window))
    found = F.when(
        F.size(hashes) > window,
        F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + F.lit(k)) for k in range(window)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return found


def covered(windows: Column, window: int = WINDOW) -> Column:
    """Words covered by the windows whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(x: Column, i: Column, of: Column) -> Column:
        near = (x["h"] == F.get(of, i - 1)["h"], x["h"] == F.get(of, i + 1)["h"])
        return F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))

    # each step's array is bound once, by a transform over a single value
    marked = F.flatten(F.transform(F.array(ordered), lambda s: F.filter(s, lambda x, i: twice(x, i, s))))
    places = F.sort_array(F.transform(marked, lambda x: x["i"]))
    spans = F.flatten(
        F.transform(
            F.array(places),
            lambda p: F.transform(
                p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))
            ),
        )
    )
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    unique = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(unique, F.lit(0).cast("long")).otherwise(total)


def measures(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts and ratios of each text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(id_column).alias("doc_id"), whole.alias("text"))
    solid = _without(F.col("text"), " \t\n\x0b\f\r")
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(rf"[^\x20\x09-\x0D]"))
    split = read.select(
        "doc_id",
        F.filter(F.split("text", WHITE + "+", -1), lambda w: w != "").alias("words"),
        lines.alias("lines"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(_without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("upper"),
        F.length(F.regexp_replace("text", "[^A-Za-z]+", "")).alias("letters"),
    )
    stop = F.array(*[F.lit(word) for word in dict.fromkeys(STOP_WORDS)])
    hashed = split.select(
        "doc_id", "word_chars", "n_symbols", "upper", "letters",
        F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size(F.filter("words", lambda w: F.array_contains(stop, F.lower(w)))).alias("n_stop"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda line: line.contains(" | "))).alias("n_bar_lines"),
    )
    windows = hashed.withColumn("windows", repeated_words(F.col("hashes")))

    def ratio(part: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(part) / F.col(of)).otherwise(F.lit(0.0))

    return windows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        covered(F.col("windows")).alias("n_repeat_words"),
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_stop", "n_words").alias("stop_ratio"),
        ratio("upper", "letters").alias("shout_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_bar_lines", "n_lines").alias("bar_line_ratio"),
    )


def verdict(rules: Sequence[Rule]) -> Column:
    """True where every rule of the table holds."""
    held = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            held = held & (F.col(rule.measure) >= F.lit(rule.least))
        if rule.most is not None:
            held = held & (F.col(rule.measure) <= F.lit(rule.most))
    return held


def apply_rules(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
