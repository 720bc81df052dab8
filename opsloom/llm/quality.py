"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` adds the counts that rules speak of; ``compile_rules`` turns a table of ``Rule`` rows into one boolean and
one list of failed rules. Both are plain column expressions: no shuffle, no Python, one pass over each text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.text import SPACES, let, words

SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the tables.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from not have but which or an "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les du un une que est pour qui dans par sur pas au avec ce il "
    "el en y los se del las por no con una su para al lo como más").split()


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose ``top / bottom`` is below ``low`` or above ``high``; an empty bottom counts as ratio 0."""

    name: str
    top: str
    bottom: str | None = None
    low: float | None = None
    high: float | None = None


#: The base conditions, which every rule set keeps.
BASE = (Rule("too_few_words", "n_words", low=50), Rule("repeated_windows", "n_repeat_words", "n_words", high=0.5))

#: Length, symbol, stop-word and line ratios. Limits leave a margin around ordinary prose.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2.5, high=12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("exclamations_per_word", "n_exclamations", "n_words", high=0.3),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("stop_words_per_word", "n_stop_words", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.4),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
)


def _repeat_words(tokens: Column) -> Column:
    """Words inside a three-word window that occurs twice or more: sort the windows, keep those with an equal neighbour."""
    last = F.size(tokens) - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)).alias("h"), i.alias("i")))

    def same(row: Column, other: Column) -> Column:
        return F.coalesce(row["h"] == other["h"], F.lit(False))

    def starts(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda w, i: same(w, F.get(ordered, i - 1)) | same(w, F.get(ordered, i + 1)))
        return F.sort_array(F.transform(twice, lambda w: w["i"]))

    def covered(at: Column) -> Column:
        steps = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")))
        return steps["n"]

    return F.when(last < 0, F.lit(0)).otherwise(let(F.sort_array(windows), lambda ordered: let(starts(ordered), covered)))


def _counts(tokens: Column, lines: Column, stop_words: Sequence[str]) -> Column:
    head = lambda line: F.substring(F.ltrim(line), 1, 1)
    return F.struct(
        F.size(tokens).cast("long").alias("n_words"),
        _repeat_words(tokens).cast("long").alias("n_repeat_words"),
        F.size(F.filter(tokens, lambda w: F.lower(w).isin(list(stop_words)))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: head(x).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…")))).cast("long").alias("n_ellipsis_lines"))


def measures(text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """One struct of counts. A null text counts as empty: every count is 0.

    Windows of three words are compared by a 64-bit hash inside one text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    without = lambda chars: F.char_length(F.translate(whole, chars, "")).cast("long")
    total = F.char_length(whole).cast("long")
    inner = let(words(text), lambda tokens: let(lines, lambda rows: _counts(tokens, rows, stop_words)))
    return let(inner, lambda c: F.struct(
        *[c[n].alias(n) for n in ("n_words", "n_repeat_words", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines",
                                  "n_ellipsis_lines")],
        without(SPACES).alias("word_chars"), (total - without(SYMBOLS)).alias("n_symbols"),
        (total - without("!")).alias("n_exclamations")))


def compile_rules(rules: Sequence[Rule], counts: Column) -> Column:
    """Array of the names of the failed rules, from a struct of counts."""
    checks = []
    for rule in rules:
        value = counts[rule.top].cast("double")
        if rule.bottom:
            value = F.when(counts[rule.bottom] > 0, value / counts[rule.bottom]).otherwise(0.0)
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        checks.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*checks))


def apply_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE,
                out: str = "quality", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``docs`` with one struct column ``out``: the counts, ``base_failed``, ``failed`` (rule names) and ``kept``.

    Null and empty texts fail the base rule on length. Every row gets a verdict of its own: repeated rows and null ids
    make no difference, and other columns pass through (one named as ``out`` is replaced).
    """
    return docs.withColumn(out, let(measures(text, stop_words), lambda c: let(
        F.struct(compile_rules(base, c).alias("b"), compile_rules(rules, c).alias("r")), lambda f: F.struct(
            *[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words",
                                      "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_exclamations")],
            (F.size(f["b"]) > 0).alias("base_failed"), F.concat(f["b"], f["r"]).alias("failed"),
            ((F.size(f["b"]) == 0) & (F.size(f["r"]) == 0)).alias("kept")))))
