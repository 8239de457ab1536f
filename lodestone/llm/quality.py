"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Cases: a null or empty text has no words and fails the length rule; a null ``doc_id`` and repeated rows are kept as they
are, one output row per input row; other columns of the input are ignored; an empty table gives an empty result. Very
long texts cost n log n in their number of words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "at", "this",
    "are", "or", "from", "de", "la", "le", "les", "des", "et", "en", "du", "un", "une", "que", "est", "pour", "dans",
    "par", "sur", "au", "el", "los", "las", "y", "se", "del", "con", "su", "es", "lo", "no", "der", "die", "und", "das",
    "den", "von", "zu", "mit", "ist", "ein", "eine", "nicht", "für", "auf", "als", "im", "dem", "sich",
)


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high`` must hold for texts of at least ``from_words`` words; None is no bound."""

    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The production threshold table.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2.5, high=12.0),
    Rule("symbol_ratio", high=0.10),
    Rule("stop_word_ratio", low=0.04, from_words=50),
    Rule("upper_ratio", high=0.30),
    Rule("dup_line_ratio", high=0.40),
    Rule("ellipsis_line_ratio", high=0.30),
    Rule("bullet_line_ratio", high=0.90),
    Rule("repeat_word_ratio", high=0.20),
)


def _spaced(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def with_metrics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts and ratios of each text, from JVM expressions only.

    A repeated five-word window is found by sorting the (hash, position) pairs of a text, and only for the texts whose
    distinct window hashes are fewer than their windows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(*[F.col(c) for c in keep], t.alias("_t"))
    trimmed = _spaced(F.col("_t"))
    step = step.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN)))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: _spaced(x) != "")
    step = step.withColumn("_l", lines).withColumn("n_words", F.size("_w").cast("long"))
    w = F.col("_w")
    window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])
    step = step.withColumn(
        "_h",
        F.when(F.col("n_words") < 5, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size("_w") - 5), window)
        ),
    )
    # Only texts with an equal pair of windows are sorted.
    step = step.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    s = F.col("_s")
    twice = F.filter(
        s,
        lambda e, j: F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)),
    )
    step = step.withColumn("_p", F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-5).alias("at"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(5), x - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    text_col, n = F.col("_t"), F.col("n_words")
    size_l = F.size("_l")
    per = lambda x, total: F.when(total > 0, x / total).otherwise(F.lit(0.0))
    count = lambda pattern: F.length(text_col) - F.length(F.regexp_replace(text_col, pattern, ""))
    stops = list(STOP_WORDS)
    lowered = F.split(F.lower(_spaced(text_col)), r"[\x20\x09-\x0D.,;:!?]+")
    step = step.select(
        *keep,
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).cast("long").alias("n_symbols"),
        (size_l - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        size_l.cast("long").alias("n_lines"),
        F.size(F.filter(lowered, lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        count(r"\p{Lu}+").cast("long").alias("n_upper"),
        F.size(F.filter("_l", lambda x: x.rlike(r"(?:\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(r"^\s*[-*•·]\s"))).cast("long").alias("n_bullet_lines"),
    )
    return step.withColumns(
        {
            "mean_word_chars": per(F.col("word_chars"), n),
            "symbol_ratio": per(F.col("n_symbols"), n),
            "stop_word_ratio": per(F.col("n_stop_words"), n),
            "upper_ratio": per(F.col("n_upper"), F.col("word_chars")),
            "dup_line_ratio": per(F.col("n_dup_lines"), F.col("n_lines")),
            "ellipsis_line_ratio": per(F.col("n_ellipsis_lines"), F.col("n_lines")),
            "bullet_line_ratio": per(F.col("n_bullet_lines"), F.col("n_lines")),
            "repeat_word_ratio": per(F.col("n_repeat_words"), n),
        }
    )


def compile_rules(rules: Sequence[Rule] = RULES) -> Column:
    """The names of the metrics whose rule a row breaks, as one array expression."""
    checks = []
    for rule in rules:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (F.col(rule.metric) < rule.low)
        if rule.high is not None:
            bad = bad | (F.col(rule.metric) > rule.high)
        checks.append(F.when((F.col("n_words") >= rule.from_words) & bad, F.lit(rule.metric)))
    return F.array_compact(F.array(*checks))


def quality_rules(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row: the counts, the ratios, ``base_failed``, the broken rules and the verdict ``kept``."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        with_metrics(docs, text, keep)
        .withColumn("base_failed", base)
        .withColumn("broken_rules", compile_rules(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    )
