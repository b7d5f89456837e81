"""Cleaning one history in place, on the driver's file system."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import LOG_MAX_BYTES, Settings
from ..sources import history as sources
from ..sources import sinks
from . import classify


@dataclass(frozen=True)
class Files:
    """The files of a history; ``log`` may be None."""

    history: Path
    exits: Path
    allowlist: Path | None = None
    log: Path | None = None


@dataclass(frozen=True)
class Report:
    removals: DataFrame
    total_lines: int


def load(spark: SparkSession, files: Files) -> tuple[DataFrame, DataFrame, list[str]]:
    """Entries, exits and patterns, under one history id."""
    own = F.lit(str(files.history)).alias("history_id")
    entries = sources.read_history(spark, str(files.history)).select(own, "entry_id", "raw", "ts", "command")
    exits = sources.read_exits(spark, str(files.exits)).select(own, "line_no", "ts_raw", "exit_code")
    allow = sources.read_allowlist(spark, str(files.allowlist)) if files.allowlist and files.allowlist.exists() else []
    return entries, exits, allow


def run(
    spark: SparkSession,
    files: Files,
    settings: Settings = Settings(),
    dry_run: bool = False,
    now: int | None = None,
    log_max_bytes: int = LOG_MAX_BYTES,
) -> Report:
    """Remove what the rules find, keep a backup, compact the exit codes, write the run log."""
    at = datetime.fromtimestamp(time.time() if now is None else now, UTC)
    with sinks.locked(files.history):
        entries, exits, allow = load(spark, files)
        found = classify.removals(entries, exits, settings, allow, int(at.timestamp()))
        # the files are about to change: what was found is fixed first, in one file's bounds
        found = spark.createDataFrame(found.orderBy("line").collect(), found.schema)
        total, gone = entries.count(), found.count()
        if not dry_run:
            kept = classify.cleaned(entries, found).orderBy("entry_id")
            compact = classify.compact_exits(exits, kept).orderBy("line_no")
            codes = [f"{r.ts_raw}:{r.exit_code}" for r in compact.toLocalIterator()]
            if gone:
                raw = [r.raw for r in kept.toLocalIterator()]
                sinks.back_up(files.history, at.astimezone())
                sinks.replace_file(files.history, iter(raw))
            if files.exits.exists():
                sinks.replace_file(files.exits, iter(codes))
    if files.log:
        totals = spark.createDataFrame([(str(files.history), total)], "history_id string, total_lines bigint")
        line = sinks.run_json(sinks.run_rows(found, totals, settings, dry_run, at)).first().value
        sinks.append_run(files.log, line, log_max_bytes)
    return Report(found, total)


def explain(spark: SparkSession, files: Files, command: str, settings: Settings = Settings(), now: int | None = None) -> DataFrame:
    """Each row of a command and its verdict; an unknown command is an error. Nothing is written."""
    entries, exits, allow = load(spark, files)
    found = classify.removals(entries, exits, settings, allow, int(time.time()) if now is None else now)
    rows = classify.explain(entries, exits, found, command).orderBy("line")
    if rows.isEmpty():
        raise LookupError(f"no entry has the command {command!r}")
    return rows


def undo(files: Files) -> Path:
    """Restore the last backup."""
    with sinks.locked(files.history):
        return sinks.restore(files.history)


def record_exit(files: Files, ts: str, code: int) -> None:
    """Append one exit code, under the history's lock."""
    with sinks.locked(files.history), open(files.exits, "a", encoding="utf-8") as out:
        out.write(f"{ts}:{code}\n")
