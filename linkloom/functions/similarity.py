"""Similarity scores of sets, strings and numbers, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import text as T


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(common(a, b) / union)


def containment(a: Column, b: Column) -> Column:
    """The share of a that b holds; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(common(a, b) / F.size(a))


def characters(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(c, "")))


def char_jaccard(a: Column, b: Column) -> Column:
    return jaccard(characters(a), characters(b))


def length_ratio(a: Column, b: Column) -> Column:
    x, y = F.char_length(a), F.char_length(b)
    return F.when((x == 0) & (y == 0), F.lit(1.0)).when((x == 0) | (y == 0), F.lit(0.0)).otherwise(F.least(x, y) / F.greatest(x, y))


def exact(a: Column, b: Column) -> Column:
    return (a == b).cast("double")




def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(T.distinct_tokens(a), T.distinct_tokens(b))


def _numbered_pairs(c: Column) -> Column:
    """The character pairs of a string, each with its number among equal ones, so that a multiset is a set."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    numbered = lambda words: F.transform(words, lambda w, i: F.concat(w, (i - F.array_position(words, w)).cast("string")))
    return F.transform(F.array(F.sort_array(pairs)), numbered)[0]  # in an array of one, since a lambda's outer expressions are computed for each element


def dice(a: Column, b: Column) -> Column:
    """Sorensen-Dice on multisets of character pairs; 1 for equal strings, 0 if either has under two characters."""
    short = (F.char_length(a) < 2) | (F.char_length(b) < 2)
    return F.when(a == b, F.lit(1.0)).when(short, F.lit(0.0)).otherwise(2 * common(_numbered_pairs(a), _numbered_pairs(b)) / (F.char_length(a) + F.char_length(b) - 2))


def numeric_overlap(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(T.digit_runs(a)), F.array_distinct(T.digit_runs(b)))


def gram_score(shared: Column, size_a: Column, size_b: Column) -> Column:
    return shared / (size_a + size_b - shared)


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))
