"""Secret scan with DataFrame functions only.

Base kinds are fixed patterns; a match that is too short is dropped after it was
found, so it still uses up its characters. Beside them, candidate strings of
``CANDIDATE`` characters are measured by Shannon entropy over a sliding window:
the window's character counts change by one incoming and one outgoing character,
and the sum of c * log2(c) with them. A candidate becomes a span when the highest
window entropy reaches its character class's threshold, unless the allow-list
covers it or a base span overlaps it. Letters without a digit must also look
unlike words (``_random_letters``).

Positions are code points, end exclusive. Where a pattern matches, the text is
split by it: the gaps' and matches' lengths add up to the positions. They are added up
in blocks of the square root of the matches' number, so that neither long texts nor
many matches cost their square. Null and empty texts have no spans. Repeated rows
are scanned each for itself. The scan is narrow; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

# fixed values; runs below the least length are left out by the pattern, as no longer run begins inside them
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
MIN_ASSIGN = 8

WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character class (whole candidate) and the least entropy in bits a character.
CLASSES = (("^[0-9]+$", 3.0), ("^[0-9a-fA-F]+$", 3.0), ("^(?:[A-Z]+|[a-z]+)=*$", 3.7), ("^[A-Za-z+/_=-]+$", 3.8), ("", 3.7))
#: What stands before a value: signs, and names up to =.
LEAD = "^[=-]*(?:[A-Za-z_][A-Za-z0-9_-]{0,30}=+(?=[^=])){0,8}"
# paths: every segment is made of words, short numbers and single letters
_PART = "(?:[A-Za-z]?[0-9]{1,8}|(?:[A-Z][a-z])?[A-Z]?[a-z]{2,15}(?:[A-Z][a-z]{2,15}){0,4}[0-9]{0,4}|[A-Z]{1,15}[0-9]{0,4}|[A-Z]?[a-z])"
_SEGMENT = f"[_+=-]{{0,2}}{_PART}(?:[_+=-]{{1,2}}{_PART}){{0,15}}[_+=-]{{0,2}}"
PATH = f"^(?=/|.*//)/*{_SEGMENT}(?:/+{_SEGMENT}){{0,40}}/*$"
#: Candidates of these forms are never reported.
ALLOW = (
    "(?i)example|sample|placeholder|changeme|xxxx",
    "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "(?i)0123456789|abcdefghij",
    "^(.{1,4})\\1{4,}",
    PATH,
)

_SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"
_MATCH = "array<struct<start:bigint,whole:string,part:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(text: Column, pattern: str, each: Callable[[Column], Column], group: int = 0) -> Column:
    """The results of ``each`` for blocks of matches (start, whole match, group's text), in order, as one array."""
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )

    def long(x):
        return (x["gap"] + F.coalesce(F.length(x["whole"]), F.lit(0))).cast("bigint")

    def step(state, x):
        begin = state["at"] + x["gap"]
        mine = F.struct(begin.alias("start"), x["whole"].alias("whole"), x["part"].alias("part"))
        # after the last match only a gap follows
        grown = F.when(x["whole"].isNull(), state["out"]).otherwise(F.array_append(state["out"], mine))
        return F.struct((state["at"] + long(x)).alias("at"), grown.alias("out"))

    zero = F.lit(0).cast("bigint")

    def matches(block, begin):
        start = F.struct(begin.alias("at"), F.array().cast(_MATCH).alias("out"))
        return F.aggregate(block, start, step, lambda s: s["out"])

    def whole(cut):
        sizes = F.transform(cut, lambda block: F.aggregate(block, zero, lambda n, x: n + long(x)))
        starts = let(sizes, lambda n: F.transform(n, lambda _, i: F.aggregate(F.slice(n, F.lit(1), i), zero, lambda a, b: a + b)))
        return F.flatten(F.zip_with(cut, starts, lambda block, begin: let(matches(block, begin), each)))

    def cut(all_):
        wide = F.ceil(F.sqrt(F.size(all_))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(all_), wide), lambda i: F.slice(all_, i, wide))

    return let(let(found, cut), whole)


def _kind(text: Column, kind: str, rank: int, pattern: str, present: str, least: int = 0, group: int = 0) -> Column:
    """Spans of one kind; ``present`` is a pattern without which there can be none."""

    def spans(block):
        return F.transform(
            F.filter(block, lambda m: F.length(m["part"]) >= least),
            lambda m: F.struct(
                m["start"].alias("start"),
                F.lit(rank).alias("rank"),
                (m["start"] + F.length(m["whole"])).alias("stop"),
                F.lit(kind).alias("kind"),
            ),
        )

    found = _blocks(text, pattern, spans, group)
    return F.when(text.rlike(present), found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest entropy of ``window`` consecutive characters, by incremental counts."""
    width = len(ALPHABET) + 1
    state = F.struct(F.array_repeat(F.lit(0), width).alias("n"), F.lit(0.0).alias("s"), F.lit(float("inf")).alias("least"))

    def clog(c):
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def put(counts, place, by):
        """``counts`` with one slot changed."""
        new = F.element_at(counts, place) + by
        return F.concat(F.slice(counts, F.lit(1), place - 1), F.array(new), F.slice(counts, place + 1, F.lit(width)))

    def over(codes):
        def step(acc, i):
            into = F.element_at(codes, i)
            out = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
            moved = (out > 0) & (out != into)
            c_in = F.element_at(acc["n"], into)
            c_out = F.element_at(acc["n"], F.greatest(out, F.lit(1)))
            counts = (
                F.when(out == into, acc["n"])
                .when(moved, let(put(acc["n"], F.greatest(out, F.lit(1)), -1), lambda n: put(n, into, 1)))
                .otherwise(put(acc["n"], into, 1))
            )
            change = clog(c_in + 1) - clog(c_in) + F.when(moved, clog(c_out - 1) - clog(c_out)).otherwise(F.lit(0.0))
            total = acc["s"] + F.when(out == into, F.lit(0.0)).otherwise(change)
            least = F.when(i >= window, F.least(acc["least"], total)).otherwise(acc["least"])
            return F.struct(counts.alias("n"), total.alias("s"), least.alias("least"))

        return F.aggregate(
            F.sequence(F.lit(1), F.size(codes)), state, step, lambda s: F.lit(math.log2(window)) - s["least"] / window
        )

    letters = F.regexp_extract_all(candidate, F.lit("(?s)."), F.lit(0))
    return let(F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c) + 1), over)


def _random_letters(word: Column) -> Column:
    """Whether letters without a digit are no words: a fifth of them outside of parts like Name or name, or few vowels in one case."""
    letters = F.regexp_count(word, F.lit("[A-Za-z]"))
    loose = F.regexp_count(F.regexp_replace(word, "[A-Z]?[a-z]{2,15}", ""), F.lit("[A-Za-z]"))
    vowels = F.regexp_count(word, F.lit("(?i)[aeiouy]"))
    both = word.rlike("[A-Z]") & word.rlike("[a-z]") & (5 * loose >= letters)
    return both | (word.rlike("^(?:[A-Z]+|[a-z]+)=*$") & (10 * vowels <= 3 * letters))


def _entropy_spans(text: Column, base: Column, allow: tuple[str, ...]) -> Column:
    def suspicious(word, start, base):
        limit = None
        for pattern, least in reversed(CLASSES):
            limit = F.lit(least) if limit is None else F.when(word.rlike(pattern), least).otherwise(limit)
        allowed = F.lit(False)
        for pattern in allow:
            allowed = allowed | word.rlike(pattern)
        mixed = word.rlike("^[0-9]+$") | F.when(word.rlike("[0-9]"), word.rlike("[A-Za-z]")).otherwise(_random_letters(word))
        stop = start + F.length(word)
        covered = F.exists(base, lambda b: (b["start"] < stop) & (start < b["stop"]))
        # the cheap tests first: the entropy is worked out for the few that pass
        return F.when(~mixed | allowed | covered, False).otherwise(window_entropy(word) >= limit)

    def part(m, base):
        """The value after signs and names, if it fills a window and is suspicious; else the whole, unless it is an option."""
        word = m["whole"]
        lead = F.length(F.regexp_extract(word, LEAD, 0))
        long = F.length(word) - lead >= WINDOW

        def span(at):
            return F.struct(
                (m["start"] + at).alias("start"),
                F.lit(4).alias("rank"),
                (m["start"] + F.length(word)).alias("stop"),
                F.lit("entropy").alias("kind"),
            )

        value = word.substr(lead + 1, F.length(word))
        option = word.rlike("^-+[A-Za-z_][A-Za-z0-9_-]*=+[^=]")
        whole = F.when(option | ((lead == 0) & long), False).otherwise(suspicious(word, m["start"], base))
        return F.when(long & suspicious(value, m["start"] + lead, base), span(lead)).when(whole, span(F.lit(0)))

    def spans(block):
        # of the base spans only those within the block's reach
        low, high = F.element_at(block, 1)["start"], F.element_at(block, -1)
        near = F.filter(base, lambda b: (b["stop"] > low) & (b["start"] < high["start"] + F.length(high["whole"])))
        return let(near, lambda own: F.filter(F.transform(block, lambda m: part(m, own)), F.isnotnull))

    def each(block):
        return F.when(F.size(block) > 0, spans(block)).otherwise(F.array().cast(_SPAN))

    spans_ = _blocks(text, CANDIDATE, each)
    return F.when(text.rlike(CANDIDATE), spans_.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def scan(docs: DataFrame, allow: tuple[str, ...] = ALLOW, base: str = "base_spans", every: str = "all_spans") -> DataFrame:
    """``docs`` with arrays of spans (start, rank, stop, kind), sorted by start and kind.

    Columns of ``docs`` that are named ``base`` or ``every`` are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(
        _kind(text, "assign", 1, ASSIGN, "(?i)password|passwd|secret|token|api_?key", MIN_ASSIGN, 2),
        _kind(text, "access", 2, ACCESS, ACCESS),
        _kind(text, "hex", 3, HEX, "[0-9a-f]{32}"),
    )
    with_base = docs.withColumn(base, F.array_sort(found))
    extra = _entropy_spans(text, F.col(base), allow)
    return with_base.withColumn(every, F.array_sort(F.concat(F.col(base), extra)))


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def redact(docs: DataFrame, mark: str = "[secret]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with every span's text replaced; overlapping spans become one mark."""
    base, spans = unused(docs, "_base", "_spans")
    found = scan(docs, allow, base, spans)
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        grown = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), grown.alias("out"))

    rest = F.aggregate(
        spans, state, step,
        lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))),
    )
    text = F.when(F.size(spans) > 0, rest).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, the base spans' digest, all spans."""
    found = scan(docs.select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("all_spans")).alias("spans"),
    )
