"""From entries and exit codes to removals, what is left, and explanations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_match, truncate, whole_seconds
from ..operators import strategies
from ..operators.stats import KEY, command_stats, counts, decay_weight, in_order, valid, with_exit
from ..settings import Settings
from ..sources.tables import materialize, scratch

SECRET = "Secret pattern:"


def verdicts(stats: DataFrame, settings: Settings = Settings(), weights: DataFrame | None = None) -> DataFrame:
    """(history_id, command, priority, reason): each command's first rule, duplicates aside.

    Secrets come first, so that they are always redacted.
    """
    prefix = strategies.failed_prefix(stats)
    found = [
        (0, strategies.secrets(stats)),
        (2, prefix),
        (3, strategies.failed_similar(stats, settings.similarity, prefix)),
        (4, strategies.cross_base_typos(stats)),
    ]
    if weights is not None:
        found.append((5, strategies.rare_variants(weights, settings.similarity, settings.rare_threshold)))
    rows = reduce(DataFrame.unionByName, [rows.withColumn("priority", F.lit(p)) for p, rows in found])
    return rows.groupBy(*KEY).agg(F.min("priority").alias("priority"), F.min_by("reason", "priority").alias("reason"))


def removals(
    entries: DataFrame,
    exits: DataFrame,
    settings: Settings = Settings(),
    allowlist: list[str] | None = None,
    now: int | None = None,
) -> DataFrame:
    """(history_id, line, reason, command) of entries to remove.

    ``now``, in seconds, is needed where rare variants are looked for. Statistics are one row
    per command; they are written once, read by all rules, and join the entries once.
    """
    if settings.remove_rare and now is None:
        raise ValueError("rare variants need the time that counts as now")
    with scratch(entries.sparkSession) as tables:
        weight = decay_weight(F.col("ts"), now) if settings.remove_rare else F.lit(0.0)
        rows = valid(entries).withColumn("w", weight)
        stats = with_exit(rows, exits).groupBy(*KEY).agg(*counts(), F.sum("w").alias("rough"))
        if settings.remove_rare:
            stats = in_order(rows.select(*KEY, "entry_id", "w"), materialize(stats, "rough"), settings.rare_threshold)
        stats = materialize(strategies.prepared(stats), "command-stats")
        tables.keep(stats)
    weights = stats if settings.remove_rare else None
    ruled = stats.select(*KEY, "last_entry_id").join(verdicts(stats, settings, weights), KEY, "left")
    rows = valid(entries).select("history_id", "entry_id", "command").join(ruled, KEY)
    older = F.col("entry_id") < F.col("last_entry_id")
    reason = F.when(F.col("priority") == 0, F.col("reason")).when(older, F.lit("Duplicate")).otherwise(F.col("reason"))
    out = rows.select("history_id", F.col("entry_id").alias("line"), reason.alias("reason"), "command").where("reason is not null")
    return apply_allowlist(out, allowlist)


def apply_allowlist(found: DataFrame, allowlist: list[str] | None) -> DataFrame:
    """Without commands that some pattern is found in; secrets stay."""
    if not allowlist:
        return found
    return found.where(F.col("reason").startswith(SECRET) | ~any_match(F.col("command"), allowlist))


def cleaned(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries that no removal names, malformed ones included."""
    gone = found.select("history_id", F.col("line").alias("entry_id"))
    return entries.join(gone, ["history_id", "entry_id"], "left_anti")


def kept_timestamps(kept: DataFrame) -> DataFrame:
    return kept.where("ts is not null").select("history_id", "ts").distinct()


def compact_exits(exits: DataFrame, kept: DataFrame) -> DataFrame:
    """The last code of each raw key whose second some kept entry has."""
    last = exits.groupBy("history_id", "ts_raw").agg(
        F.max_by("exit_code", "line_no").alias("exit_code"), F.max("line_no").alias("line_no")
    )
    rows = last.withColumn("ts", whole_seconds("ts_raw")).join(kept_timestamps(kept), ["history_id", "ts"], "left_semi")
    return rows.select("history_id", "line_no", "ts_raw", "exit_code")


def explain(entries: DataFrame, exits: DataFrame, found: DataFrame, command: str) -> DataFrame:
    """Each row of a command: its counts and KEEP or REMOVE with the reason.

    Verdicts depend on all commands, so only their result is narrowed to this one.
    """
    stats = command_stats(entries, exits).where(F.col("command") == command)
    rows = valid(entries).where(F.col("command") == command).select("history_id", F.col("entry_id").alias("line"), "ts", "command")
    rows = rows.join(found.select("history_id", "line", "reason"), ["history_id", "line"], "left")
    verdict = F.when(F.col("reason").isNull(), F.lit("KEEP")).otherwise(F.concat(F.lit("REMOVE "), "reason"))
    counts = stats.select("history_id", "success_count", "failed_count")
    return rows.join(counts, "history_id").select(
        "history_id", "line", "ts", "command", "success_count", "failed_count", verdict.alias("verdict")
    )


def numbered(found: DataFrame) -> DataFrame:
    """Removals with their place in the order of a report: by history, then by line."""
    order = Window.partitionBy("history_id").orderBy("line")
    rows = found.withColumn("place", F.row_number().over(order))
    return rows.repartitionByRange("history_id", "line").sortWithinPartitions("history_id", "line")


def reason_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("history_id", "reason").agg(F.count("*").alias("n"))


def histogram(found: DataFrame) -> DataFrame:
    """Counts by reason over all histories, largest first."""
    return found.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def redacted(found: DataFrame) -> DataFrame:
    hidden = F.when(F.col("reason").startswith(SECRET), F.lit("<redacted>")).otherwise(F.col("command"))
    return found.withColumn("command", hidden)


def reason_samples(found: DataFrame, most: int = 5) -> DataFrame:
    """The first removals of each reason, secrets hidden and commands shortened."""
    return strategies.samples(redacted(found), most).withColumn("command", truncate("command"))
