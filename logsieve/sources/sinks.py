"""Sinks: Spark writes for many histories, and one history's own files on the driver."""

from __future__ import annotations

import contextlib
import fcntl
import os
import shutil
import tempfile
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.classify import redacted
from ..settings import BACKUPS, LOG_MAX_BYTES, Settings


def append_exits(exits: DataFrame, path: str) -> None:
    """Append ``<ts>:<code>`` lines."""
    text = F.concat_ws(":", F.col("ts_raw"), F.col("exit_code").cast("string"))
    exits.select(text.alias("value")).write.mode("append").text(path)


def write_histories(kept: DataFrame, path: str) -> None:
    """Entries' raw lines, a folder for each history, in order within it; its files follow one another by number.

    ``read_history(..., folders=True)`` reads them.
    """
    rows = kept.repartitionByRange("history_id", "entry_id").sortWithinPartitions("history_id", "entry_id")
    rows.select("history_id", F.col("raw").alias("value")).write.mode("errorifexists").partitionBy("history_id").text(path)


def line_totals(entries: DataFrame) -> DataFrame:
    """(history_id, total_lines)"""
    return entries.groupBy("history_id").agg(F.count("*").alias("total_lines"))


def run_rows(found: DataFrame, totals: DataFrame, settings: Settings, dry_run: bool, at: datetime) -> DataFrame:
    """A row of the run log for each history of ``totals`` (history_id, total_lines); commands that hold secrets are hidden.

    A row holds its history's removals, as the run log's lines do; histories do not meet.
    """
    counts = found.groupBy("history_id", "reason").agg(F.count("*").alias("n"))
    counts = counts.groupBy("history_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reason_counts")
    )
    rows = redacted(found).groupBy("history_id").agg(
        F.count("*").alias("removed_count"),
        F.array_sort(F.collect_list(F.struct("line", "reason", "command"))).alias("removals"),
    )
    runs = totals.join(rows, "history_id", "left").join(counts, "history_id", "left")
    return runs.select(
        "history_id",
        F.lit(at.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("timestamp"),
        F.lit(dry_run).alias("dry_run"),
        F.struct(
            F.lit(settings.similarity).alias("similarity"),
            F.lit(settings.rare_threshold).alias("rare_threshold"),
            F.lit(settings.remove_rare).alias("remove_rare"),
        ).alias("settings"),
        "total_lines",
        F.coalesce("removed_count", F.lit(0)).alias("removed_count"),
        F.coalesce("reason_counts", F.create_map().cast("map<string,bigint>")).alias("reason_counts"),
        F.coalesce("removals", F.array().cast(rows.schema["removals"].dataType)).alias("removals"),
    )


def run_json(runs: DataFrame) -> DataFrame:
    """(history_id, value): each run as a JSON line."""
    fields = [c for c in runs.columns if c != "history_id"]
    return runs.select("history_id", F.to_json(F.struct(*fields)).alias("value"))


def write_runs(runs: DataFrame, path: str) -> None:
    """Append run logs, a folder for each history."""
    run_json(runs).write.mode("append").partitionBy("history_id").text(path)


def append_run(path: str | os.PathLike, line: str, max_bytes: int = LOG_MAX_BYTES) -> None:
    """Append a JSON line; a log of at least ``max_bytes`` (if above 0) becomes ``.1`` first."""
    path = Path(path)
    if max_bytes > 0 and path.exists() and path.stat().st_size >= max_bytes:
        os.replace(path, f"{path}.1")
    with open(os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o600), "a", encoding="utf-8") as log:
        log.write(line + "\n")


@contextlib.contextmanager
def locked(history: str | os.PathLike) -> Iterator[None]:
    """An exclusive lock beside the history, held until the block ends."""
    with open(f"{history}.lock", "a") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        yield


def replace_file(path: Path, lines: Iterator[str]) -> None:
    """Write lines to a file beside ``path``, then put it in its place; readable by its owner only."""
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with open(handle, "w", encoding="utf-8", newline="") as out:
            for line in lines:
                out.write(line + "\n")
            out.flush()
            os.fsync(out.fileno())
        os.chmod(name, 0o600)
        os.replace(name, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(name)
        raise
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def backups(history: Path) -> list[Path]:
    return sorted(history.parent.glob(f"{history.name}.backup-*"))


def back_up(history: Path, at: datetime, keep: int = BACKUPS) -> Path:
    """Copy the history beside itself; of all its copies the last ``keep`` by name stay."""
    copy = history.with_name(f"{history.name}.backup-{at:%Y%m%d-%H%M%S}")
    shutil.copy2(history, copy)
    for old in backups(history)[:-keep]:
        old.unlink()
    return copy


def restore(history: Path) -> Path:
    """Put the last copy back; it stays."""
    found = backups(history)
    if not found:
        raise FileNotFoundError(f"no backup of {history}")
    shutil.copy2(found[-1], history)
    return found[-1]
