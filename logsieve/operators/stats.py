"""Joins and aggregates over entries and exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_command, whole_seconds

KEY = ["history_id", "command"]


def valid(entries: DataFrame) -> DataFrame:
    return entries.where("ts is not null and command is not null")


def exit_by_second(exits: DataFrame) -> DataFrame:
    """One code for each history and whole second: the last line's."""
    return exits.groupBy("history_id", whole_seconds("ts_raw").alias("ts")).agg(
        F.max_by("exit_code", "line_no").alias("exit_code")
    )


def with_exit(entries: DataFrame, exits: DataFrame) -> DataFrame:
    """``entries`` with their exit codes; seconds are joined as text."""
    return entries.join(exit_by_second(exits), ["history_id", "ts"], "left").select(*entries.columns, "exit_code")


def command_stats(entries: DataFrame, exits: DataFrame) -> DataFrame:
    """A row for each command of a history: its entries, successes, failures and last entry."""
    return with_exit(valid(entries), exits).groupBy(*KEY).agg(*counts())


def counts() -> list[Column]:
    return [
        F.count("*").alias("n_entries"),
        F.count_if(F.col("exit_code") == 0).alias("success_count"),
        F.count_if(F.col("exit_code") != 0).alias("failed_count"),
        F.max("entry_id").alias("last_entry_id"),
    ]


def line_ids(entries: DataFrame) -> DataFrame:
    """Each command's entries as an array: for reports; the operators join instead."""
    return valid(entries).groupBy(*KEY).agg(F.array_sort(F.collect_list("entry_id")).alias("line_ids"))


def base_totals(stats: DataFrame) -> DataFrame:
    """Runs with a known outcome, and successes, for each first word."""
    return stats.groupBy("history_id", base_command("command").alias("base")).agg(
        F.sum(F.col("success_count") + F.col("failed_count")).alias("total"),
        F.sum("success_count").alias("successes"),
        F.sum("failed_count").alias("failures"),
    )


def decay_weight(ts: Column, now: int) -> Column:
    """1 up to seven days, 0.5 up to thirty, 0.1 beyond; 0 for what is no 64-bit number."""
    second = ts.try_cast("bigint")
    age = F.lit(now).cast("decimal(20,0)") - second.cast("decimal(20,0)")
    day = 24 * 3600
    return F.when(second.isNull(), 0.0).when(age <= 7 * day, 1.0).when(age <= 30 * day, 0.5).otherwise(0.1)


#: How many times heavier than a rare command the common variant must be.
HEAVIER = 3.0


def decayed_weights(entries: DataFrame, now: int, rare_threshold: float = 3.0) -> DataFrame:
    """Each command's decayed weight.

    Sums that the rules could compare closely, up to a little above ``HEAVIER`` times the
    threshold, are added in the order of entries; a weight is 0.1 at least (zeros add
    nothing), so the rows that meet are bounded by the threshold too.
    """
    rows = valid(entries).select(*KEY, "entry_id", decay_weight(F.col("ts"), now).alias("w"))
    rough = rows.groupBy(*KEY).agg(F.sum("w").alias("rough"))
    return in_order(rows, rough, rare_threshold).select(*KEY, "weight")


def in_order(rows: DataFrame, rough: DataFrame, rare_threshold: float) -> DataFrame:
    """``rough`` with weight: the sum of the weights w of ``rows``, in the order of entries where it matters."""
    limit = HEAVIER * max(rare_threshold, 1.0) + 1
    small = rows.where("w > 0").join(rough.where(F.col("rough") < limit).select(*KEY), KEY, "left_semi")
    weights = F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "w"))), lambda x: x["w"])
    exact = small.groupBy(*KEY).agg(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x).alias("exact"))
    return rough.join(exact, KEY, "left").withColumn("weight", F.coalesce("exact", "rough")).drop("exact", "rough")


def keep_newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that are not the last of their key: the greatest is aggregated and joined, no group is sorted.

    Null is a key like any other, and comes first in ``order``. Of rows that tie for the last the one
    with the greatest hash of all columns counts as last; rows that are equal in all columns count as one.
    """
    place = F.struct(F.col(order), F.xxhash64(*rows.columns))
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    last = rows.groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(F.max(place).alias("_last"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.join(last, same).where(place < F.col("_last")).select(*[rows[c] for c in rows.columns])
