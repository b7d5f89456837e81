"""Edit distances: native bounds first, the exact distance for what is left."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

#: Whole commands at least so similar are typos although what follows their heads differs.
FALLBACK = 0.95
_ANY = 2**31 - 1


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance in characters.

    Rows over ``a``; ``seen`` has, for each character, the last row in which it stood.
    """
    if a == b:
        return 0
    # what both begin and end with costs nothing
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    a, b = a[low:], b[low:]
    high = 0
    while high < min(len(a), len(b)) and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[: len(a) - high], b[: len(b) - high]
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    far = n + m
    table = [[far] * (m + 2), [far, *range(m + 1)]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        for j, y in enumerate(b, 1):
            swap_from, swap_to = seen.get(y, 0), match
            cost = x != y
            row.append(
                min(
                    table[i][j] + cost,
                    row[j] + 1,
                    table[i][j + 1] + 1,
                    table[swap_from][swap_to] + (i - swap_from - 1) + 1 + (j - swap_to - 1),
                )
            )
            if not cost:
                match = j
        table.append(row)
        seen[x] = i
    return table[-1][-1]


@F.pandas_udf(T.IntegerType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    found = [None if x is None or y is None else damerau(x, y) for x, y in zip(a, b, strict=True)]
    return pd.Series(found, dtype="Int32")


def ratio(a: Column | str, b: Column | str) -> Column:
    """1 for equal texts, else 1 - distance / greater length."""
    a, b = col(a), col(b)
    return F.when(a == b, 1.0).otherwise(1 - damerau_levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def within_one(a: Column | str, b: Column | str) -> Column:
    """Distance exactly 1, natively: one edit, or one swap of neighbours."""
    a, b = col(a), col(b)
    swapped = F.exists(
        F.sequence(F.lit(1), F.length(a) - 1),
        lambda i: a
        == F.concat(
            b.substr(F.lit(1), i - 1), b.substr(i + 1, F.lit(1)), b.substr(i, F.lit(1)), b.substr(i + 2, F.length(b))
        ),
    )
    even = (F.length(a) == F.length(b)) & (F.length(a) > 1) & (a != b)
    return (F.levenshtein(a, b) == 1) | F.when(even, swapped).otherwise(False)


def halves(text: Column | str) -> Column:
    """Six keys of ``text``: texts within one edit or swap share one, whatever their length.

    For each length that the other text may have: with h half the shorter length, either the first h
    characters are equal, or the last ones from the shorter's character h + 2 on.
    """
    text = col(text)
    n = F.length(text)

    def pair(more: int) -> list[Column]:
        short, long = (n + more, n) if more < 0 else (n, n + more)
        h = F.floor(short / 2).cast("int")
        first, last = F.left(text, h), F.right(text, F.greatest(short - h - 1, F.lit(0)))
        return [F.when(short >= 0, F.xxhash64(short, long, F.lit(side), part)) for side, part in enumerate((first, last))]

    return F.array_compact(F.array(*[key for more in (-1, 0, 1) for key in pair(more)]))


def search_radius(threshold: float, length: Column | str) -> Column:
    """The greatest distance at which a text of ``length`` is looked up at all."""
    length = col(length)
    if threshold >= 1 or threshold < 0:
        return F.lit(0)
    if threshold == 0:
        return F.when(length == 0, 0).otherwise(_ANY)
    wide = F.ceil(F.lit((1.0 - threshold) / threshold) * length)
    return F.when(length == 0, 0).otherwise(F.least(wide, F.lit(_ANY))).cast("int")


def maybe_within(a: Column | str, b: Column | str, radius: Column) -> Column:
    """False only where the distance exceeds ``radius``: length difference <= d and Levenshtein <= 2 d."""
    a, b = col(a), col(b)
    # beyond the texts' lengths the radius says nothing; the bound keeps it an int
    limit = F.least(radius.cast("long") * 2, (F.length(a) + F.length(b)).cast("long")).cast("int")
    native = F.levenshtein(a, b)
    return (F.abs(F.length(a) - F.length(b)) <= radius) & (native <= limit)


def heads_may_match(a: Column, b: Column, threshold: float) -> Column:
    """False only where the heads' lengths, or twice the bound on edits, rule a match out."""
    most = F.lit(1 - threshold) * F.greatest(F.length(a), F.length(b)) + 1e-9
    return (a != b) & (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= 2 * most)


def similar(pairs: DataFrame, left: dict[str, Column], right: dict[str, Column], threshold: float) -> DataFrame:
    """Of ``pairs`` of commands (norm, head, rest) those that differ by a typo in the head.

    The rest must be equal, or the whole normalised commands at least ``FALLBACK`` alike. The heads'
    distance comes first, and the whole commands' only where a native bound leaves it open.
    """
    head = pairs.withColumn("_head", ratio(left["head"], right["head"])).where((F.col("_head") >= threshold) & (F.col("_head") < 1.0))
    a, b = left["norm"], right["norm"]
    equal = left["rest"] == right["rest"]
    most = F.lit(1 - FALLBACK) * F.greatest(F.length(a), F.length(b)) + 1e-9
    maybe = (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= 2 * most)
    left_open = head.where(equal | maybe)
    whole = left_open.withColumn("_whole", ratio(F.when(equal, "").otherwise(a), F.when(equal, "").otherwise(b)))
    return whole.where(F.col("_whole") >= FALLBACK).drop("_head", "_whole")
