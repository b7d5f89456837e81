"""A command log derived from the ``events`` table, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The command of an event, in the SQL that both engines share.
COMMAND = """CASE
 WHEN event_id % 997 = 3 THEN 'export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfiCYQ1w2e3r4t5y6'
 WHEN event_id % 991 = 4 THEN 'git push https://bot:hunter22@git.test/r'
 WHEN event_id % 983 = 5 THEN 'gh auth login --with ghp_0a1b2c3d4e5f6g7h8i9j0k1l2m3n4o5p6q7r'
 WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'git statsu'
 WHEN event_type = 'error' AND event_id % 11 = 1 THEN 'gti status'
 WHEN event_type = 'error' AND event_id % 11 = 2 THEN 'cargo bui'
 WHEN event_type = 'error' AND event_id % 11 = 3 THEN 'docker sp'
 WHEN event_id % 97 = 5 THEN 'cargo biuld'
 WHEN event_id % 4 = 0 THEN 'git status'
 WHEN event_id % 4 = 1 THEN 'cargo build'
 WHEN event_id % 4 = 2 THEN 'docker ps'
 ELSE 'git log --oneline' END"""

#: Events whose line is malformed, and exits that are recorded with a fraction of a second.
MALFORMED, FRACTION = "event_id % 89 = 7", "event_id % 3 = 1"

#: The time that counts as now: 2024-02-01, after the events.
NOW = 1706745600

SQL = f"""WITH a AS (
 SELECT CAST(user_id % 20 AS varchar) AS history_id, event_id AS entry_id,
  CAST(CAST(floor(epoch(ts)) AS bigint) AS varchar) AS second, {COMMAND} AS written,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS code, {MALFORMED} AS malformed, {FRACTION} AS fraction
 FROM events),
h AS (SELECT history_id, entry_id, second AS ts, written AS command, code FROM a WHERE NOT malformed),
x AS (SELECT history_id, second AS ts, arg_max(code, entry_id) AS exit_code FROM a GROUP BY ALL),
e AS (SELECT h.history_id, h.entry_id, h.ts, h.command, x.exit_code FROM h LEFT JOIN x USING (history_id, ts)),
s AS (SELECT history_id, command, count(*) AS n_entries, count(*) FILTER (WHERE exit_code = 0) AS success_count,
  count(*) FILTER (WHERE exit_code <> 0) AS failed_count, max(entry_id) AS last_entry_id FROM e GROUP BY ALL),
b AS (SELECT history_id, split_part(command, ' ', 1) AS base, CAST(sum(success_count + failed_count) AS bigint) AS total,
  CAST(sum(success_count) AS bigint) AS successes, CAST(sum(failed_count) AS bigint) AS failures FROM s GROUP BY ALL),
p AS (SELECT *, split_part(command, ' ', 1) AS base, array_to_string(string_split(command, ' ')[1:2], ' ') AS head,
  array_to_string(string_split(command, ' ')[3:], ' ') AS rest FROM s)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    return events.select(
        (F.col("user_id") % 20).cast("string").alias("history_id"),
        F.col("event_id").alias("entry_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("ts"),
        F.expr(COMMAND).alias("command"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("code"),
        F.expr(MALFORMED).alias("malformed"),
        F.expr(FRACTION).alias("fraction"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = ~F.col("malformed")
    head = F.when(good, F.concat(F.lit(": "), "ts", F.lit(":0;"))).otherwise("x")
    return _events(spark, sf_dir).select(
        "history_id", "entry_id", F.concat(head, "command").alias("raw"), F.when(good, F.col("ts")).alias("ts"), F.when(good, F.col("command")).alias("command")
    )


def exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        "history_id",
        F.col("entry_id").alias("line_no"),
        F.when(F.col("fraction"), F.concat("ts", F.lit(".25"))).otherwise(F.col("ts")).alias("ts_raw"),
        F.col("code").alias("exit_code"),
    )
