"""Columns that read and compare section labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The families, longest prefix first.
GRAMMAR = "^(WT|HP|MC|W|M|C)([0-9]+)X([0-9]+)$"
#: Letters that print like digits.
LIKE_DIGITS = ("OIL", "011")


def normalised(printed: Column) -> Column:
    """Upper case, without spaces."""
    return F.upper(F.replace(printed, F.lit(" "), F.lit("")))


def family_of(label: Column) -> Column:
    """The longest family that the label begins with, or an empty string."""
    return F.regexp_extract(label, "^(WT|HP|MC|W|M|C)", 1)


def parsed(label: Column) -> dict[str, Column]:
    """family, depth and weight of a whole label; nulls where the grammar does not fit."""
    part = lambda k: F.nullif(F.regexp_extract(label, GRAMMAR, k), F.lit(""))
    return {"family": part(1), "depth": part(2).cast("long"), "weight": part(3).cast("long")}


def grams(text: Column, n: int) -> Column:
    """The distinct character n-grams of a text; a shorter text is its own only gram."""
    return F.when(F.length(text) <= n, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


#: What a scanner's reading is repaired by, in this order.
REPAIRS = (
    ("\u00a0", " "),
    ("[×✕]", "X"),
    ("[–—]", "-"),
    ("(?i)(?<=\\w)\\s+X\\s+(?=\\w)", "X"),
    ("(?<=\\d)\\s*/\\s*(?=\\d)", "/"),
    ("(?i)(?<=[A-Z])O(?=\\d)", "0"),
    ("(?i)(?<=\\d)O(?=\\d)", "0"),
    ("(?<=\\d)[|I](?=\\d)", "1"),
    ("[ \\t]+", " "),
)


def repaired(text: Column) -> Column:
    """Dashes, multiplication signs and spaces in one form; O and I between digits, or O between a letter and a digit, as the digits they print like."""
    for pattern, put in REPAIRS:
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text)


def closed_json(text: Column) -> Column:
    """A JSON text that was cut off, with the quote, braces and brackets closed that it leaves open.

    Whole strings are taken out first; a quote that is left opens the string in which the text ends.
    """
    bare = F.regexp_replace(text, '"(?:[^"\\\\]++|\\\\[\\s\\S])*+"', "")
    nesting = F.regexp_replace(F.split_part(bare, F.lit('"'), F.lit(1)), "[^{}\\[\\]]", "")
    signs = F.filter(F.split(nesting, ""), lambda ch: ch != "")
    closers = F.aggregate(signs, F.lit(""), lambda left, ch: F.when(ch.isin("{", "["), F.concat(F.translate(ch, "{[", "}]"), left)).otherwise(F.substring(left, F.lit(2), F.length(left))))
    ended = F.when(bare.contains('"'), F.concat(text, F.lit('"'))).otherwise(F.regexp_replace(F.rtrim(text), ",$", ""))
    return F.concat(ended, closers)
