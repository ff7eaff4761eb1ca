"""Statistics of a text as column expressions, for the quality operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, words

WINDOW = 8


def counts(text: Column) -> dict[str, Column]:
    """Plain counts; all of them are longs."""
    own = {
        "n_chars": F.length(text),
        "n_lines": F.regexp_count(text, F.lit("\n")) + 1,
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_marks": F.regexp_count(text, F.lit(r"[!?]")),
        "n_digits": F.regexp_count(text, F.lit("[0-9]")),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_stops": F.regexp_count(text, F.lit(r"[.,;:]")),
        "n_others": F.regexp_count(text, F.lit(r"[^\p{L}\x20\x09-\x0D]")),
        "n_plain": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])\p{L}++[.,;:!?]?(?![^\x20\x09-\x0D])")),
        "n_pipes": F.regexp_count(text, F.lit(r"[|•]|\n[-*] ")),
    }
    return {k: v.cast("long") for k, v in own.items()}


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines that have a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows of so many words that occur twice or more in the text. hashes: a hash for each word.

    Only texts in which some window repeats sort their windows; then each repeated window adds what the one before
    it hasn't covered.
    """
    starts = F.sequence(F.lit(1), F.size(hashes) - (window - 1))
    none = F.array().cast("array<bigint>")
    windows = F.when(F.size(hashes) >= window, F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, window)))).otherwise(none)

    def covered(placed: Column) -> Column:
        twice = F.filter(
            F.transform(placed, lambda x, k: F.when((F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()
        )
        twice = F.transform(twice, lambda i: i.cast("long"))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).cast("long").alias("last"))
        return F.aggregate(F.array_sort(twice), start, lambda s, i: F.struct((s["n"] + F.least(F.lit(window).cast("long"), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])

    def of(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(once(placed, covered))

    return once(windows, of)


def stutters(hashes: Column) -> Column:
    """Words that equal the word before them."""
    return F.size(F.filter(hashes, lambda h, i: h == F.get(hashes, i - 1))).cast("long")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once though use names it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))
