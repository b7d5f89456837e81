"""Column functions over command text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(text: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(text), "(?U)^\\s+|\\s+\\z", "")


def base_command(command: Column | str) -> Column:
    """The first word; empty if there is none."""
    return F.regexp_extract(col(command), "(?U)^\\s*(\\S+)", 1)


# fixed values: a token's form and what stands for it, the first that fits
PLACEHOLDERS = (
    ("(?dU)^https?://", "<URL>"),
    ("(?dU)^/", "<PATH>"),
    ("(?dU)^v\\d+\\.\\d+\\.\\d+\\z", "<VER>"),
    ("(?dU)^[0-9a-fA-F]{6,}\\z", "<SHA>"),
)


def normalize(command: Column | str) -> Column:
    """Words joined by one blank, those that vary (addresses, paths, versions, hashes) by a placeholder."""

    def one(token: Column) -> Column:
        bare = F.regexp_replace(token, "(?s)^([\"'])(.*)\\1\\z", "$2")
        out = token
        for pattern, mark in reversed(PLACEHOLDERS):
            out = F.when(bare.rlike(pattern), F.lit(mark)).otherwise(out)
        return out

    words = F.filter(F.split(col(command), "(?U)\\s+"), lambda t: t != "")
    return F.array_join(F.transform(words, one), " ")


_PIECE = re.compile(
    r"""'(?P<single>[^']*)(?:'|\Z)|"(?P<double>(?:\\["\\]|[^"])*)(?:"|\Z)|\\(?P<any>.)|(?P<lone>\\\Z)|(?P<blank>[ \t]+)|(?P<plain>[^ \t'"\\]+)""",
    re.S,
)
_ESCAPED = re.compile(r'\\(["\\])')


def shell_words(text: str) -> list[str]:
    """Words as a shell splits them; an open quote runs to the end, a lone last backslash goes."""
    words: list[list[str]] = []
    inside = False
    for m in _PIECE.finditer(text):
        kind = m.lastgroup
        if kind == "blank":
            inside = False
        elif kind != "lone":
            piece = _ESCAPED.sub(r"\1", m[kind]) if kind == "double" else m[kind]
            if not inside:
                words.append([])
            words[-1].append(piece)
            inside = True
    return ["".join(w) for w in words]


@F.pandas_udf(T.StructType([T.StructField("head", T.StringType()), T.StructField("rest", T.StringType())]))
def split_command(commands: pd.Series) -> pd.DataFrame:
    """The first two shell words and the others."""
    words = [shell_words(c) if c is not None else None for c in commands]
    return pd.DataFrame(
        {
            "head": [None if w is None else " ".join(w[:2]) for w in words],
            "rest": [None if w is None else " ".join(w[2:]) for w in words],
        }
    )


def truncate(text: Column | str, most: int = 70) -> Column:
    """At most ``most`` characters, the last three of a shortened text being dots."""
    text = col(text)
    if most < 3:
        return text
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def whole_seconds(ts: Column | str) -> Column:
    return F.split_part(col(ts), F.lit("."), F.lit(1))


def any_match(text: Column, patterns: list[str]) -> Column:
    """Whether some pattern is found in ``text``."""
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(f"(?dU){p}")
    return out
