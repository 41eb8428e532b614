"""Counts of a text's parts, as column expressions; null texts count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six kinds of ASCII white space that part words.
GAPS = " \t\n\x0b\f\r"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def characters_but(text: Column, without: str) -> Column:
    """Characters that aren't among `without`."""
    return F.length(F.translate(_text(text), without, "")).cast("long")


def line_count(text: Column) -> Column:
    """Lines as parted by line feeds; an empty text has one."""
    return (F.length(_text(text)) - characters_but(text, "\n") + 1).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """n_words, mean_word (characters in words over words), n_lines, digit_share (of characters in words); null where there is nothing to divide by."""
    n, inside = word_count(text), characters_but(text, GAPS)
    digits = inside - characters_but(text, GAPS + "0123456789")
    return {"n_words": n.cast("double"), "mean_word": inside / F.nullif(n, F.lit(0)), "n_lines": line_count(text).cast("double"), "digit_share": digits / F.nullif(inside, F.lit(0))}
