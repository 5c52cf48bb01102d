"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each measure is a column expression over the whole text; each rule names a measure, a
comparison and a bound; ``measure`` computes all measures in one projection and ``judge``
compiles the rule table into one boolean expression. There is no shuffle and no Python.

Defined results: a null text is an empty one (no words); a document without words has
ratios 0 and fails the base rule; rows are judged one by one, so repeated rows get equal
verdicts and an empty table gives an empty result; other input columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import SEPARATORS, SPACE_RE, unpack, with_row_struct

SYMBOLS = "#*$%&|<>"
# A to Z and the capitals of Latin-1
CAPITALS = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Function words of the corpus languages (en, de, fr, es): running prose has some, lists and noise few.
STOP_WORDS = ("the of and to in is that for it as was with be by on are this an or from a at not "
              "der die das und zu den von mit ist im ein eine des sich auf nicht dem "
              "le la les de des et un une que qui en du dans est pour au sur par il "
              "el los las y que en un una por con para del se no su al es").split()


@dataclass(frozen=True)
class Rule:
    """Fails a document when ``measure`` is outside [low, high] (None: open)."""
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.2),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("upper_ratio", None, 0.6),
)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; an empty array when there is none."""
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def _repeat_words(windows: Column, n: int) -> Column:
    """Words covered by windows whose hash occurs twice or more: sort (hash, start), keep
    the starts with an equal neighbour, and add up what each start covers before the next."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    size = F.size(pairs)

    def starts_of(p):
        same = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(s):
        return F.aggregate(s, F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("sum")),
                           lambda acc, i: F.struct(i.alias("last"),
                                                   (acc["sum"] + F.least(F.lit(n), i - acc["last"])).alias("sum")),
                           lambda acc: acc["sum"])
    # one-element transforms bind an intermediate array once instead of repeating its expression
    bound = F.transform(F.array(pairs), lambda p: F.transform(F.array(starts_of(p)), lambda s: covered(s)))
    return F.when(size > 0, F.flatten(bound)[0]).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (struct of the input) and the measures of every rule."""
    d = with_row_struct(docs)
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    d = d.select("row", text.alias("text"))
    d = d.select("row", "text", words_of(F.col("text")).alias("words"))
    n = F.size("words")
    # the words are bound once outside the inner lambda: were the column's own expression copied
    # into it (a filter on a measure does that), every window would split the text again
    hashes = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.array("words"), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
                                                lambda i: F.xxhash64(F.slice(w, i, WINDOW))))[0])
    d = d.select("row", "text", "words", n.cast("long").alias("n_words"), hashes.alias("windows"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    d = d.select(
        "row", "n_words",
        F.length(F.translate("text", SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long"))
        .otherwise(_repeat_words(F.col("windows"), WINDOW)).alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"(?<![\p{L}\p{N}])(?i:" + "|".join(sorted(set(STOP_WORDS)))
                                     + r")(?![\p{L}\p{N}])")).cast("long").alias("n_stop"),
        (F.length("text") - F.length(F.translate("text", CAPITALS, ""))).cast("long").alias("n_upper"))
    d = d.select("row", "n_words", "word_chars", "n_symbols",
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.size("lines").cast("long").alias("n_lines"), "n_repeat_words", "n_stop", "n_upper")

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.select("*", ratio("word_chars", "n_words").alias("mean_word_chars"),
                    ratio("n_symbols", "n_words").alias("symbols_per_word"),
                    ratio("n_stop", "n_words").alias("stop_ratio"),
                    ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
                    ratio("n_upper", "word_chars").alias("upper_ratio"))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.measure) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.measure) > r.high)
        broken.append(F.when(bad, F.lit(r.measure)))
    failed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return measured.select("*", base.alias("base_failed"), failed.alias("failed_rules")) \
        .select("*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The input rows that pass, with exactly the input columns."""
    # A filter is copied down through projections, and with it every measure it names, at each
    # use again; a column that must not be computed twice keeps it above them.
    judged = judge(measure(docs, text_col), rules).select("row", "kept", F.monotonically_increasing_id().alias("nth"))
    return unpack(judged.where("kept and nth >= 0"), docs.columns)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, all measures and the verdict."""
    j = judge(measure(docs, text_col), rules)
    return j.select(F.col("row").getField(id_col).alias("doc_id"), *[c for c in j.columns if c != "row"])


def op9(docs: DataFrame) -> DataFrame:
    return quality_report(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                       "n_repeat_words", "base_failed", "kept", "failed_rules")
