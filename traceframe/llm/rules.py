"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.llm.common import SPACE, SPACE_CLASS

# Frequent function words of the four languages; a running text of any of them holds several.
STOP_WORDS = (
    "the of and to in a is that for it with as was on be by this are "
    "der die das und den von zu mit ist des im nicht ein eine sich auf "
    "le la les de des et un une que pour dans est pas au "
    "el los las del y en una por con se no su al"
).split()
SYMBOLS = "#*$%&|<>"


def _by_first_letter(words: Sequence[str]) -> str:
    """Alternatives of a pattern, the words of a letter behind one choice."""
    tails: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        tails.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{head}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for head, rest in tails.items())


_WHITE = r"[\x20\x09-\x0D]"
#: A stop word in any ASCII case between white space or the ends of the text.
STOP_PATTERN = rf"(?i)(?:^|{_WHITE})(?:{_by_first_letter(STOP_WORDS)})(?={_WHITE}|\z)"


@dataclass(frozen=True)
class Threshold:
    """A text passes if low <= metric <= high; a null bound is open, a null metric passes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Share metrics are per word unless the name says otherwise.
PRODUCTION = (
    Threshold("length", "n_words", 50, None),
    Threshold("word_length", "mean_word_chars", 2.0, 14.0),
    Threshold("symbols", "symbol_share", None, 0.25),
    Threshold("shouting", "upper_share", None, 0.5),
    Threshold("letters", "letter_word_share", 0.6, None),
    Threshold("stop_words", "stop_word_share", 0.01, None),
    Threshold("line_repeats", "dup_line_share", None, 0.5),
    Threshold("word_repeats", "repeat_word_share", None, 0.5),
    Threshold("ellipsis", "ellipsis_line_share", None, 0.5),
)


def _let(value: Column, use) -> Column:
    """`use(v)` with `value` evaluated once: a one-element transform keeps it inside a single projection."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words between white space, an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def repeated_words(w: Column, window: int = 3) -> Column:
    """Words that lie in a window of `window` words found twice or more in the text, first occurrences included.

    Windows are sorted with their positions, so equal ones are neighbours; the positions of those are put in order again
    and each adds the words up to the next one. n log n in the length of the text.
    """

    def count(s: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            return F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])

        hits = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-window).alias("last"))
        total = F.aggregate(
            hits,
            start,
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(window), i - acc["last"])).cast("bigint").alias("n"), i.alias("last")
            ),
        )
        return total["n"]

    positions = F.sequence(F.lit(0), F.size(w) - window)
    windows = F.transform(
        positions, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(window)]).alias("h"), i.alias("i"))
    )
    return F.when(F.size(w) > window, _let(F.sort_array(windows), count)).otherwise(F.lit(0).cast("bigint"))


def measured(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with the counts that the metrics rest on, each a bigint; null and empty texts count as no words.

    A document is one row of work: nothing is shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.col("__w")
    blank = SPACE
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    with_words = docs.withColumn("__w", words(F.col(text)))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(t, blank, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(w),
        "n_upper": F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
        "n_letter_words": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
        "n_stop_words": F.regexp_count(t, F.lit(STOP_PATTERN)),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
    }
    return with_words.select(*docs.columns, *[c.cast("bigint").alias(prefix + n) for n, c in counts.items()])


def metrics(prefix: str = "") -> dict[str, Column]:
    """The metrics a threshold may name, from the columns of `measured`; shares of nothing are null."""
    c = lambda n: F.col(prefix + n)
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b))
    return {
        "n_words": c("n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "letter_word_share": share("n_letter_words", "n_words"),
        "stop_word_share": share("n_stop_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"),
        "ellipsis_line_share": share("n_ellipsis_lines", "n_lines"),
    }


def failed_rules(table: Sequence[Threshold], prefix: str = "") -> Column:
    """Names of the thresholds that a measured text misses, in the order of the table."""
    known = metrics(prefix)
    tests = []
    for t in table:
        m = known[t.metric]
        miss = F.lit(False)
        if t.low is not None:
            miss = miss | (m < t.low)
        if t.high is not None:
            miss = miss | (m > t.high)
        tests.append(F.when(F.coalesce(miss, F.lit(False)), F.lit(t.name)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, table: Sequence[Threshold] = PRODUCTION, text: str = "text") -> DataFrame:
    """`docs` with the measured counts (names begin with `q_`), `failed_rules` and `kept`.

    Null and empty texts have zero counts and fail the length rule. Repeated rows are judged alike, each on its own.
    Columns of `docs` named like an output are dropped before. No shuffle, no user function.
    """
    out = {"failed_rules", "kept"}
    base = docs.select(*[c for c in docs.columns if c not in out and not c.startswith("q_")])
    m = measured(base, text, "q_")
    return m.withColumn("failed_rules", failed_rules(table, "q_")).withColumn("kept", F.size("failed_rules") == 0)
