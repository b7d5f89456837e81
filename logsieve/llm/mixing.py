"""Mixing sources to target weights by a time-varying curriculum.

A source's target is its weight's share of all words, at most ``MAX_EPOCHS`` times
what it has; what a capped source cannot take is shared again by weight, until none is above.

Each source's weight moves over the training run: a piecewise linear schedule is
integrated into the source's cumulative demand, which reaches its target at the end
of the run. A source's documents stand one after another in the order of a hash of id and
text, and around again for further epochs. Each copy's training position is where the
demand reaches the middle of the copy; a copy whose middle the demand never reaches is
not taken. Documents are range-sorted by position.

Cumulative sizes are summed in two levels, first over the hash buckets of a source
and then within one bucket, so that a source with a third of all rows is spread
over ``16**BUCKET_DIGITS`` groups. Sources may be very many: their ranks are numbered within
range partitions, and the level above which targets are capped is found by aggregates.

A null text has size 0, a null source is a source of its own (last in order), a
null id hashes like the empty text. Repeated rows count each for itself. Without
words all targets are 0. A source without words keeps each document once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_DIGITS = 4
#: For each weight in turn, its schedule over the run: (time, relative weight) at knots.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.6, 0.8), (1.0, 2.0)),
)
_WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def pieces_of(schedule) -> tuple[list[tuple[float, float, float, float, float]], float]:
    """A schedule's integral by pieces: (below it, up to its end, its time, weight and slope), and the whole."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (w0 + w1) / 2 * (t1 - t0)
        pieces.append((total, total + area, t0, w0, (w1 - w0) / (t1 - t0)))
        total += area
    return pieces, total


def time_of(share: Column, schedule) -> Column:
    """When a schedule's integral, as a share of the whole, reaches ``share``."""
    pieces, total = pieces_of(schedule)
    out = None
    for low, high, t0, w0, slope in reversed(pieces):
        left = F.greatest(share * total - low, F.lit(0.0))
        root = left / w0 if slope == 0 else (F.sqrt(F.greatest(w0 * w0 + 2 * slope * left, F.lit(0.0))) - w0) / slope
        at = F.lit(t0) + root
        out = at if out is None else F.when(share * total < high, at).otherwise(out)
    return F.least(out, F.lit(1.0))


def _numbered(sums: DataFrame) -> DataFrame:
    """``sums`` and each source's rank (from 0, null last), without gathering them in one task."""
    order = F.col("source").asc_nulls_last()
    n = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(sums.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "sources")
    # a row for each partition
    parts = dealt.groupBy("part").agg(F.count("*").alias("k"))
    before = parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    return dealt.join(F.broadcast(before), "part").select("source", "source_size", place.alias("rank"))


def targets(sums: DataFrame) -> DataFrame:
    """source, source_size -> source, source_size, weight's place, target."""
    place = (F.col("rank") % len(WEIGHTS)).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("place") + 1)
    rows = _numbered(sums).withColumn("place", place).withColumn("weight", weight)
    rows = materialize(rows.select("source", "source_size", "place", "weight"), "weights")

    def left(capped: Column) -> tuple:
        """Words and weight that are left to the sources that are not capped, and how many are."""
        return rows.agg(
            F.coalesce(F.sum(F.col("source_size") - F.when(capped, MAX_EPOCHS * F.col("source_size")).otherwise(0)), F.lit(0)),
            F.coalesce(F.sum(F.when(capped, 0).otherwise(F.col("weight"))), F.lit(0)),
            F.count_if(capped),
        ).first()

    words, weights, n = left(F.lit(False))
    level = None
    while weights:
        level = words / weights
        words, weights, more = left(F.col("weight") * F.lit(level) > MAX_EPOCHS * F.col("source_size"))
        if more == n:
            break
        n = more
    every = (MAX_EPOCHS * F.col("source_size")).cast("double")
    target = every if level is None else F.least(F.col("weight") * F.lit(level), every)
    return rows.select("source", "source_size", "place", target.alias("target"))


def _assigned(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (these columns of ``docs``), size, source_size, target, copies, taken, positions."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))
    sized = docs.select(row, "source", size_of().alias("size"), key.alias("key"))
    sized = sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    # used twice; written once, the texts are not read again for them
    buckets = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("sum")), "mixing")
    # at most 16**BUCKET_DIGITS rows of a source
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("sum").over(order), F.lit(0)))
    sums = buckets.groupBy("source").agg(F.sum("sum").alias("source_size"))
    plan = starts.join(targets(sums).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    at = F.struct(F.col("source").alias("s"), F.col("bucket").alias("b")).alias("at")
    plan = plan.select(at, "start", "source_size", "target", "place")
    rows = sized.select("row", "size", "key", at)
    upto = Window.partitionBy("at").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("size").over(upto)).join(plan, "at")
    rows = rows.withColumn("middle", F.col("start") + F.col("end") - F.col("size") / 2)

    def position(k: int) -> Column:
        """Where the demand for copy ``k`` is met; null if it isn't."""
        wanted = k * F.col("source_size") + F.col("middle")
        share = F.when(F.col("target") > 0, wanted / F.col("target")).otherwise(0.0)
        here = None
        for place, schedule in enumerate(SCHEDULES):
            time = time_of(share, schedule)
            here = time if here is None else F.when(F.col("place") == place, time).otherwise(here)
        again = F.lit(True) if k == 0 else F.col("source_size") > 0
        return F.when((wanted <= F.col("target")) & again, here)

    rows = rows.withColumn("positions", F.filter(F.array(*map(position, range(MAX_EPOCHS))), F.isnotnull))
    return rows.select(
        "row", "size", "source_size", "target", F.size("positions").alias("copies"),
        (F.col("size") * F.size("positions")).cast("long").alias("taken"), "positions",
    )


_ADDED = ("size", "source_size", "target", "copies", "taken", "positions")


def assign(docs: DataFrame) -> DataFrame:
    """``docs`` with size, source_size, target, copies, taken and positions (one for each copy), which replace columns so named."""
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in _ADDED]
    return _assigned(docs, docs.columns).select(*kept, *_ADDED)


def report(docs: DataFrame) -> DataFrame:
    """A row for each document, range-sorted by its first position; those not taken come last."""
    # the texts stay where they are
    rows = _assigned(docs, ["doc_id"]).select(
        "row.doc_id", "size", "source_size", "target", "taken", "copies", F.get("positions", F.lit(0)).alias("first_position")
    )
    first = F.col("first_position").asc_nulls_last()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, first, "doc_id").sortWithinPartitions(first, "doc_id")


def curriculum(docs: DataFrame) -> DataFrame:
    """A row for each copy taken, with ``docs``' columns, range-sorted by training position."""
    rows = _assigned(docs, docs.columns).select("row", F.explode("positions").alias("position"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "position", "row.doc_id").sortWithinPartitions("position", "row.doc_id")
    return dealt.select(*[F.col(f"row.`{c}`") for c in docs.columns])
