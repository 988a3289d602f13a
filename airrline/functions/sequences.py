"""Sequence matching as built-in column expressions: no Python on the executors, no text spliced into SQL."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

from airrline.names import c
from airrline.schema import SeqOptions


def exact(col: Column, pattern: str) -> Column:
    """Equality; NULL for NULL."""
    return col == F.lit(pattern)


def regex(col: Column, pattern: str) -> Column:
    """Whether the pattern is found anywhere in the text (Java regular expressions)."""
    return col.rlike(pattern)


def levenshtein(col: Column, pattern: str, max_dist: int | None = None) -> Column:
    """Edit distance in characters; with a bound, NULL beyond it and for texts whose length rules it out."""
    if max_dist is None:
        return F.levenshtein(col, F.lit(pattern)).cast("long")
    near = F.length(col).between(len(pattern) - max_dist, len(pattern) + max_dist)
    d = F.levenshtein(col, F.lit(pattern), max_dist)
    return F.when(near, F.when(d >= 0, d)).cast("long")


def hamming(col: Column, pattern: str) -> Column:
    """Differing places; NULL unless the lengths agree. Unrolled, so it stays in generated code."""
    differs = [(F.substring(col, i, 1) != F.lit(ch)).cast("long") for i, ch in enumerate(pattern, 1)]
    return F.when(F.length(col) == len(pattern), reduce(add, differs, F.lit(0).cast("long")))


def match_columns(options: SeqOptions) -> list[Column]:
    """One column for each pattern: flags for exact and regex, distances for lev and hamm."""
    col = c(options.query_col)
    make = {"exact": exact, "regex": regex, "hamm": hamming, "lev": levenshtein}[options.method]
    return [make(col, p) for p in options.patterns]


def match_predicate(options: SeqOptions) -> Column:
    """Whether any pattern matches (within ``max_dist`` for distances)."""
    col = c(options.query_col)
    if options.method == "exact":
        return col.isin(*options.patterns)
    if options.method == "regex":
        return reduce(or_, [regex(col, p) for p in options.patterns])
    if options.method == "lev":
        return reduce(or_, [levenshtein(col, p, options.max_dist).isNotNull() for p in options.patterns])
    return reduce(or_, [F.coalesce(hamming(col, p) <= options.max_dist, F.lit(False)) for p in options.patterns])
