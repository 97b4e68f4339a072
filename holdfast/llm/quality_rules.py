"""Quality rules: one Spark projection compiled from a table of thresholds, without user functions.

Words are runs of characters other than space and U+0009..U+000D. All comparisons are between whole
numbers, so a document on a limit is judged alike everywhere.

NULL text counts as empty: all numbers 0, base_failed true. Rows are independent of each other, so
ties and repeated rows change nothing, an empty table gives an empty result, and other columns are
carried along; a column whose name clashes with a result column is replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
# Frequent function words, lower case, of the languages that are handled.
STOP_WORDS = (
    "the of and to in is that for it was on are as with be this by from or an "
    "der die das und ist von zu mit den für auf im nicht ein eine "
    "le la les de des et est un une que qui dans pour sur au avec "
    "el los las y en es del se por con no una su para al"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails a document if numerator * 100 is under `least` or over `most` percent of the denominator."""

    name: str
    numerator: str
    denominator: str
    least: int | None = None
    most: int | None = None


# Percentages; word_chars against n_words means characters per word.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=200, most=1200),
    Rule("symbols", "n_symbols", "n_words", most=25),
    Rule("exclamation_marks", "n_exclamations", "n_words", most=75),
    Rule("stop_words", "n_stop_words", "n_words", least=6),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=40),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=30),
)


def _paired(hashes: str, reach: int) -> Column:
    """Hash of every element with the one `reach` places on."""
    rest = F.greatest(F.size(hashes) - reach, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), rest), F.slice(hashes, F.lit(reach + 1), rest), lambda x, y: F.xxhash64(x, y))


def _repeated_words(hashes: str, distinct: str, pairs: str) -> tuple[Column, Column, Column]:
    """Window hashes sorted with their starts, starts of those that occur again, words they cover."""
    ordered = F.when(
        F.col(distinct) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
    )
    again = F.sort_array(F.transform(
        F.filter(pairs, lambda y, k: (F.get(pairs, k - 1)["x"].eqNullSafe(y["x"])) | (F.get(pairs, k + 1)["x"].eqNullSafe(y["x"]))),
        lambda y: y["i"],
    ))
    covered = F.aggregate(
        F.transform("_again", lambda p, j: F.when(j == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get("_again", j - 1)))),
        F.lit(0), lambda total, n: total + n,
    )
    return ordered, again, F.coalesce(covered, F.lit(0)).cast("bigint")


def _verdict(rules: tuple[Rule, ...]) -> Column:
    passed = F.lit(True)
    for rule in rules:
        hundredfold, base = F.col(rule.numerator) * 100, F.col(rule.denominator)
        if rule.least is not None:
            passed = passed & (hundredfold >= base * rule.least)
        if rule.most is not None:
            passed = passed & (hundredfold <= base * rule.most)
    return passed


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds the counts, base_failed and kept to every row of docs."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations",
              "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")
    docs = docs.drop(*(c for c in (*counts, "base_failed", "kept") if c != text))
    names = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    stripped = F.btrim(body, F.lit(" \t\n\x0b\f\r"))
    long = "bigint"
    step = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), body.alias("_body"),
        F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, SPACE + "+")).alias("_words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    step = step.withColumns({
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "n_words": F.size("_words").cast(long),
        "word_chars": F.char_length(F.array_join("_words", "")).cast(long),
        "n_symbols": F.regexp_count("_body", F.lit(r"[#*$%&|<>]")).cast(long),
        "n_exclamations": (F.octet_length("_body") - F.octet_length(F.replace("_body", F.lit("!"), F.lit("")))).cast(long),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS, *(s.capitalize() for s in STOP_WORDS)))).cast(long),
        "n_lines": F.size("_lines").cast(long),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast(long),
        "n_bullet_lines": F.size(F.filter("_lines", lambda line: line.rlike(r"^[\x20\x09]*[-*•]"))).cast(long),
        "n_ellipsis_lines": F.size(F.filter("_lines", lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast(long),
    })
    for reach in (1, 2, 4):  # hashes of 2, 4 and at last 8 successive words
        step = step.withColumn("_hashes", _paired("_hashes", reach))
    step = step.withColumn("_distinct", F.size(F.array_distinct("_hashes")))
    ordered, again, covered = _repeated_words("_hashes", "_distinct", "_pairs")
    step = step.withColumn("_pairs", ordered).withColumn("_again", again).withColumn("n_repeat_words", covered)
    step = step.withColumn(
        "base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    )
    return step.withColumn("kept", ~F.col("base_failed") & _verdict(rules)).select(
        *(F.col(f"_row.`{c}`").alias(c) for c in names), *counts, "base_failed", "kept"
    )
