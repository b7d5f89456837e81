"""Sources: command logs, exit codes, allow-lists and run logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim

ENTRIES = "history_id string, entry_id bigint, raw string, ts string, command string"
EXITS = "history_id string, line_no bigint, ts_raw string, exit_code int"
_LINE = "(?s)^(?:: )?([0-9]+):([^;]*);(.*)\\z"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(history_id, line_no, line): physical lines of whole files, invalid UTF-8 replaced.

    A file is one row until it is split, as the order of its lines is what counts.
    ``history_id`` is the file's path.
    """
    files = spark.read.format("binaryFile").load(path)
    text = F.expr("make_valid_utf8(cast(content as string))")
    rows = files.select(F.col("path").alias("history_id"), F.split(text, "\n", -1).alias("all"))
    # what follows the last line feed is a line only if it isn't empty
    ended = F.element_at("all", -1) == ""
    kept = F.when(ended, F.slice("all", F.lit(1), F.greatest(F.size("all") - 1, F.lit(0)))).otherwise(F.col("all"))
    return rows.select("history_id", F.posexplode(kept).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


def lines_in_blocks(spark: SparkSession, path: str | list[str], folders: bool = False) -> DataFrame:
    """``lines`` of files of any size, with the block of the file that a line begins in; ``fold`` takes one task for each.

    Blocks are the reader's splits. ``line_no`` rises with the place in the file, but has gaps. A byte
    order mark at a file's start is not kept. With ``folders`` a folder is one log: its files follow one another
    in the order in which a Spark write numbered them, and ``history_id`` is the folder's path.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select(
        F.col("_metadata.file_path").alias("history_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.expr("make_valid_utf8(value)").alias("line"),
    )
    # a block has no more lines than bytes, so its numbers end before those of the next
    first = F.min("at").over(Window.partitionBy("history_id", "block"))
    rows = rows.select("history_id", "block", (F.col("block") + F.col("at") - first).alias("line_no"), "line")
    if not folders:
        return rows
    # names of one write differ in length only where numbers have more digits
    folder, file = F.regexp_extract("history_id", "^(.*)/", 1), F.regexp_extract("history_id", "[^/]*$", 0)
    place = F.struct(F.length(file).alias("digits"), file.alias("file"), F.col("block").alias("start"))
    return rows.select(folder.alias("history_id"), place.alias("block"), "line_no", "line")


def _begins_in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with entry_id and last, worked out within blocks and from one summary row of each."""
    ends = rows.groupBy("history_id", "block").agg(
        F.count_if(~F.col("goes_on")).alias("closed"), F.max_by("goes_on", "line_no").alias("end")
    )
    order = Window.partitionBy("history_id").orderBy("block")
    # a line begins an entry where the line before it does not go on
    opens = F.coalesce(~F.lag("end").over(order), F.lit(True))
    ends = ends.withColumns({"opens": opens, "final": F.lead("block").over(order).isNull()})
    here = F.col("closed") + F.col("opens").cast("bigint") - (~F.col("end")).cast("bigint")
    before = F.coalesce(F.sum(here).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("history_id", "block", "opens", "final", before.alias("before"))
    within = Window.partitionBy("history_id", "block").orderBy("line_no")
    rows = rows.join(ends, ["history_id", "block"])
    begins = F.coalesce(~F.lag("goes_on").over(within), F.col("opens"))
    rows = rows.withColumns({"begins": begins, "last": F.lead("line_no").over(within).isNull() & F.col("final")})
    return rows.withColumn("entry_id", F.col("before") + F.sum(F.col("begins").cast("bigint")).over(within) - 1)


def fold(physical: DataFrame) -> DataFrame:
    """Physical lines -> (history_id, entry_id, raw, text).

    A line that ends in an odd run of backslashes goes on in the next one. ``raw``
    keeps the backslash, ``text`` only the line feed. Lines with a ``block`` are folded block by
    block, others history by history.
    """
    goes_on = F.length(F.regexp_extract("line", "(\\\\*)\\z", 1)) % 2 == 1
    rows = physical.withColumn("goes_on", goes_on)
    if "block" in physical.columns:
        rows = _begins_in_blocks(rows)
    else:
        order = Window.partitionBy("history_id").orderBy("line_no")
        begins = F.coalesce(~F.lag("goes_on").over(order), F.lit(True))
        rows = rows.withColumns({"begins": begins, "last": F.lead("line_no").over(order).isNull()})
        rows = rows.withColumn("entry_id", F.sum(F.col("begins").cast("bigint")).over(order) - 1)
    piece = F.struct(
        *(c for c in ("block", "line_no") if c in physical.columns),
        F.col("line").alias("raw"),
        F.when(F.col("goes_on") & ~F.col("last"), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line")).alias("text"),
    )
    folded = rows.groupBy("history_id", "entry_id").agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    return folded.select(
        "history_id",
        "entry_id",
        F.array_join(F.transform("parts", lambda p: p["raw"]), "\n").alias("raw"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"),
    )


def parsed(text: Column) -> tuple[Column, Column]:
    """Timestamp and command of a line ``: <ts>:<duration>;<command>``; both null where it is malformed."""
    command = trim(F.regexp_extract(text, _LINE, 3))
    good = text.rlike(_LINE) & (command != "")
    return F.when(good, F.regexp_extract(text, _LINE, 1)), F.when(good, command)


def parse(folded: DataFrame) -> DataFrame:
    ts, command = parsed(F.col("text"))
    return folded.select("history_id", "entry_id", "raw", ts.alias("ts"), command.alias("command"))


def read_history(spark: SparkSession, path: str | list[str], blocks: bool = False, folders: bool = False) -> DataFrame:
    """Entries of command logs; malformed lines are kept with null ts and command.

    With ``blocks`` a file is read and folded by its blocks, so it may be of any size. With ``folders``, which
    implies blocks, each folder is one log in several files, as ``sinks.write_histories`` writes them.
    """
    physical = lines_in_blocks(spark, path, folders) if blocks or folders else lines(spark, path)
    return parse(fold(physical))


def parse_exits(physical: DataFrame) -> DataFrame:
    """``<ts>:<code>`` lines -> exits; blank, malformed and out-of-range ones are passed over."""
    text = trim("line")
    code = F.regexp_extract(text, "(?s)^[^:]*:(.*)\\z", 1)
    rows = physical.select(
        "history_id",
        "line_no",
        F.regexp_extract(text, "(?s)^([^:]*):", 1).alias("ts_raw"),
        F.when(code.rlike("^[+-]?[0-9]+\\z"), code.try_cast("int")).alias("exit_code"),
        text.contains(":").alias("split"),
    )
    return rows.where("split and exit_code is not null").drop("split")


def read_exits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Recorded exit codes; none if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return parse_exits(lines(spark, path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EXITS)


def read_allowlist(spark: SparkSession, path: str) -> list[str]:
    """Patterns, one a line; blank lines and those with # are none. A bad pattern is an error.

    Look-around and back-references are errors too: they are not part of the patterns' language.
    """
    found = [r.value.strip() for r in spark.read.option("lineSep", "\n").text(path).toLocalIterator()]
    patterns = [p for p in found if p and not p.startswith("#")]
    for p in patterns:
        if re.search(r"\(\?<?[=!]|\\[1-9]", p):
            raise ValueError(f"not allowed in an allow-list pattern: {p}")
        # the engine that will use it compiles it
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(f"(?dU){p}")
    return patterns


RUN = (
    "timestamp string, dry_run boolean,"
    " settings struct<similarity: double, rare_threshold: double, remove_rare: boolean>,"
    " total_lines bigint, removed_count bigint, reason_counts map<string, bigint>,"
    " removals array<struct<line: bigint, reason: string, command: string>>"
)


def parse_run_log(log: DataFrame, *more: str) -> DataFrame:
    """(line_no, line, ``more`` columns) of run logs -> one row per run; lines that aren't JSON objects are passed over."""
    run = F.from_json("line", RUN, {"mode": "PERMISSIVE"})
    objects = log.where(F.col("line").rlike("^\\s*\\{")).select(*more, "line_no", run.alias("run"))
    return objects.where("run.timestamp is not null").select(*more, "line_no", "run.*")


def read_run_log(spark: SparkSession, path: str, last: int = 5) -> DataFrame:
    """The last runs of a log, with their counts (largest first) and samples that aren't duplicates."""
    runs = parse_run_log(lines(spark, path)).orderBy(F.desc("line_no")).limit(last)
    counts = F.array_sort(
        F.map_entries("reason_counts"),
        lambda a, b: F.when(a["value"] != b["value"], F.when(a["value"] > b["value"], -1).otherwise(1)).otherwise(
            F.when(a["key"] < b["key"], -1).otherwise(1)
        ),
    )
    other = F.filter("removals", lambda r: r["reason"] != "Duplicate")
    samples = F.transform(
        F.slice(other, 1, 5),
        lambda r: F.struct(r["line"].alias("line"), r["reason"].alias("reason"), F.substring(r["command"], 1, 70).alias("command")),
    )
    return runs.withColumns({"counts": counts, "samples": samples}).orderBy("line_no")
