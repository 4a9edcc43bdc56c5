"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule's cost and rejection rate is measured on a sample; the cascade then runs the rules in the order
of rejections per second. The order changes the time, never the verdict: a document is kept when no rule
rejects it. Rules are written over the text itself inside one CASE, so that a rule behind a rejection is not evaluated.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of, words_of

#: Words of a window, and the characters counted as symbols.
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
NOT_SYMBOLS = "[^#*$%&|<>]+"

#: Rows of the sample from which the order of the rules is estimated (about as many; the verdict doesn't depend on it).
SAMPLE_ROWS = 1000


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long each).

    Null texts count as empty, and empty texts have zeros. Repeated ids are measured row by row.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    base = base.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.octet_length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    base = base.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice(F.col("hashes"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), windows.alias("windows"))
    # most texts repeat no window; only the others sort their windows with the places
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    base = base.withColumn("placed", F.when(repeats, placed)).drop("windows")
    again = F.transform("placed", lambda e, j: F.when(
        (F.get(F.col("placed"), j - 1)["h"] == e["h"]) | (F.get(F.col("placed"), j + 1)["h"] == e["h"]), e["i"]))
    base = base.withColumn("starts", F.sort_array(F.filter(again, lambda x: x.isNotNull()))).drop("placed")
    covered = F.aggregate(
        F.transform("starts", lambda p, k: F.coalesce(F.least(F.get(F.col("starts"), k + 1) - p, F.lit(WINDOW)),
                                                      F.lit(WINDOW)).cast("long")),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def base_failed() -> Column:
    """The base rule over :func:`measures`: too short, or too much of the text in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules() -> dict[str, Callable[[Column], Column]]:
    """Rejection rules over a whole text; true rejects. Null never arises (texts are coalesced)."""
    def chars(x: Column) -> Column:
        return F.char_length(F.regexp_replace(x, "[\\x20\\x09-\\x0D]+", ""))

    def only(x: Column, others: str) -> Column:
        return F.char_length(F.regexp_replace(x, others, ""))

    def lines(x: Column) -> Column:
        return F.filter(F.split(x, "\n", -1), lambda s: F.octet_length(F.btrim(s, F.lit(" \t\n\x0b\x0c\r"))) > 0)

    return {
        "symbols": lambda x: only(x, NOT_SYMBOLS) * 10 > F.size(words_of(x)),
        "capitals": lambda x: only(x, "[^\\p{Lu}]+") * 100 > 40 * chars(x),
        "digits": lambda x: only(x, "[^0-9]+") * 100 > 40 * chars(x),
        "repeated_lines": lambda x: (F.size(lines(x)) - F.size(F.array_distinct(lines(x)))) * 100 > 30 * F.size(lines(x)),
        "no_letters": lambda x: only(x, "[^\\p{L}]+") * 100 < 50 * chars(x),
        "word_length": lambda x: ~(chars(x) / F.greatest(F.size(words_of(x)), F.lit(1))).between(2.0, 25.0),
    }


def cascade_order(docs: DataFrame, rules: dict[str, Callable[[Column], Column]], text_col: str = "text",
                  sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by falling rejections per second, both measured on a sample (an empty table keeps the given order)."""
    n = docs.count()
    if not n:
        return list(rules)
    share = min(1.0, sample_rows / n)
    sample = staged(docs.sample(withReplacement=False, fraction=share, seed=7).select(text_of(text_col).alias("text")), "rule_sample")
    sample.agg(F.sum(F.octet_length("text"))).first()  # files open before the first timing
    worth = {}
    for name, rule in rules.items():
        began = time.perf_counter()
        row = sample.agg(F.count_if(rule(F.col("text"))).alias("hit"), F.count(F.lit(1)).alias("n")).first()
        cost = max(time.perf_counter() - began, 1e-4)
        worth[name] = (row["hit"] + 0.5) / (row["n"] + 1) / cost
    return sorted(rules, key=lambda k: -worth[k])


def rejected_by(order: list[str], rules: dict[str, Callable[[Column], Column]], text: Column, first: Column | None = None) -> Column:
    """The first rule in ``order`` that rejects, else null. ``first`` is a condition already known to reject."""
    out = F.when(first, F.lit("base")) if first is not None else None
    for name in order:
        out = (out.when if out is not None else F.when)(rules[name](text), F.lit(name))
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: dict[str, Callable[[Column], Column]] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, the measures, base_failed, kept.

    kept is false where the base rule or any rule rejects. Null and empty texts fail the base rule. Extra columns are ignored.
    """
    rules = default_rules() if rules is None else rules
    order = cascade_order(docs, rules, text_col, sample_rows)
    m = measures(docs, id_col, text_col).withColumn("base_failed", base_failed())
    verdict = rejected_by(order, rules, F.col("text"), F.col("base_failed"))
    return m.withColumn("kept", verdict.isNull()).drop("text", "n_lines")
