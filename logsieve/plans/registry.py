"""The queries of the log-cleaning operators, each with its SQL."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance, text
from ..operators import stats, strategies
from ..settings import Settings
from ..sources import history, sinks
from ..sources.tables import fresh_path
from . import classify
from . import derived as d

SETTINGS = Settings(remove_rare=True)
ALLOW = ["^git "]
EXPLAINED = "git statsu"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.command_stats(d.entries(spark, sf_dir), d.exits(spark, sf_dir))


def _removals(spark: SparkSession, sf_dir: str, allow: list[str] | None = None) -> DataFrame:
    return classify.removals(d.entries(spark, sf_dir), d.exits(spark, sf_dir), SETTINGS, allow, d.NOW)


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.cleaned(d.entries(spark, sf_dir), _removals(spark, sf_dir))


# SQL of the rules; each is (history_id, command, reason)
_PREFIX = """SELECT f.history_id, f.command, 'Failed prefix of ''' || min(g.command) || '''' AS reason
 FROM p f JOIN p g ON f.history_id = g.history_id AND f.base = g.base
 WHERE f.failed_count > 0 AND g.success_count > 0 AND starts_with(g.command, f.command)
  AND length(g.command) > length(f.command) AND g.success_count > f.failed_count
 GROUP BY f.history_id, f.command"""
_ALIKE = """damerau_levenshtein({a}.head, {b}.head) > 0
  AND 1 - damerau_levenshtein({a}.head, {b}.head) / greatest(length({a}.head), length({b}.head)) >= 0.8
  AND ({a}.rest = {b}.rest OR 1 - damerau_levenshtein({a}.command, {b}.command) / greatest(length({a}.command), length({b}.command)) >= 0.95)"""
_SIMILAR = f"""SELECT history_id, command, 'Failed similar to ''' || other || '''' AS reason FROM (
 SELECT f.history_id, f.command, g.command AS other,
  row_number() OVER (PARTITION BY f.history_id, f.command ORDER BY damerau_levenshtein(f.command, g.command), g.command) AS place
 FROM p f JOIN p g ON f.history_id = g.history_id AND f.base = g.base
 WHERE f.failed_count > 0 AND g.success_count > f.failed_count AND f.command <> g.command
  AND damerau_levenshtein(f.command, g.command) <= ceil((1 - 0.8::DOUBLE) / 0.8::DOUBLE * length(f.command))
  AND {_ALIKE.format(a="f", b="g")}
  AND (f.history_id, f.command) NOT IN (SELECT (history_id, command) FROM ({_PREFIX}))) WHERE place = 1"""
_CROSS = """SELECT s.history_id, s.command, 'Cross-base typo of ''' || t.common || '''' AS reason FROM s JOIN (
 SELECT r.history_id, r.base, c.base AS common, row_number() OVER (PARTITION BY r.history_id, r.base ORDER BY c.total DESC, c.base) AS place
 FROM b r JOIN b c ON r.history_id = c.history_id AND damerau_levenshtein(r.base, c.base) = 1
 WHERE r.failures > 0 AND r.successes <= 2 AND c.total >= 20) t
 ON s.history_id = t.history_id AND split_part(s.command, ' ', 1) = t.base AND t.place = 1 WHERE s.success_count = 0"""
_WEIGHTS = f"""SELECT history_id, command, list_reduce(list(w ORDER BY entry_id), lambda a, b: a + b) AS weight FROM (
 SELECT history_id, command, entry_id, CASE WHEN {d.NOW} - CAST(ts AS bigint) <= 604800 THEN 1.0::DOUBLE
  WHEN {d.NOW} - CAST(ts AS bigint) <= 2592000 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS w FROM h) GROUP BY ALL"""
_RARE = f"""SELECT history_id, command, 'Rare variant of ''' || other || '''' AS reason FROM (
 SELECT r.history_id, r.command, c.command AS other,
  row_number() OVER (PARTITION BY r.history_id, r.command ORDER BY damerau_levenshtein(r.command, c.command), c.command) AS place
 FROM (SELECT p.*, weight FROM p JOIN ({_WEIGHTS}) USING (history_id, command)) r
 JOIN (SELECT p.*, weight FROM p JOIN ({_WEIGHTS}) USING (history_id, command)) c
  ON r.history_id = c.history_id AND r.base = c.base AND r.command <> c.command
 WHERE r.weight <= 3.0 AND c.weight > 3.0 * r.weight AND {_ALIKE.format(a="r", b="c")}) WHERE place = 1"""


def _secret_sql(column: str) -> str:
    quoted = [(n, p.replace("'", "''")) for n, p in strategies.SECRETS]
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in quoted) + " END"


_SECRETS = f"""SELECT history_id, command, 'Secret pattern: ' || name AS reason FROM
 (SELECT *, {_secret_sql("command")} AS name FROM s) WHERE name IS NOT NULL"""
_REMOVALS = f"""SELECT history_id, line, arg_min(reason, priority) AS reason, command FROM (
 SELECT e.history_id, e.entry_id AS line, v.reason, e.command, v.priority FROM e JOIN (
  SELECT *, 0 AS priority FROM ({_SECRETS}) UNION ALL SELECT *, 2 FROM ({_PREFIX}) UNION ALL SELECT *, 3 FROM ({_SIMILAR})
  UNION ALL SELECT *, 4 FROM ({_CROSS}) UNION ALL SELECT *, 5 FROM ({_RARE})) v USING (history_id, command)
 UNION ALL SELECT e.history_id, e.entry_id, 'Duplicate', e.command, 1 FROM e JOIN s USING (history_id, command)
  WHERE e.entry_id < s.last_entry_id) GROUP BY history_id, line, command"""
_WITH_R = f"{d.SQL}, r AS ({_REMOVALS})"
_WITH_K = f"{_WITH_R}, k AS (SELECT history_id, entry_id, CASE WHEN NOT malformed THEN second END AS ts, CASE WHEN NOT malformed THEN written END AS command FROM a WHERE (history_id, entry_id) NOT IN (SELECT (history_id, line) FROM r))"


def dedup_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.entries(spark, sf_dir).select("history_id", "entry_id", "command")
    return stats.keep_newest(stats.valid(d.entries(spark, sf_dir)).select(*rows.columns), ["history_id", "command"], "entry_id")


def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("digest"))
    return stats.keep_newest(docs, ["digest"], "doc_id").select("doc_id")


def command_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


def line_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform("line_ids", lambda x: x.cast("string")), ",")
    return stats.line_ids(d.entries(spark, sf_dir)).select("history_id", "command", ids.alias("line_ids"))


def exit_code_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.with_exit(d.entries(spark, sf_dir), d.exits(spark, sf_dir))
    return rows.select("history_id", "entry_id", "ts", "exit_code")


def base_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.base_totals(_stats(spark, sf_dir)).where(F.col("total") >= strategies.COMMON)


def failed_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.failed_prefix(_stats(spark, sf_dir))


def failed_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _stats(spark, sf_dir)
    return strategies.failed_similar(found, SETTINGS.similarity, strategies.failed_prefix(found))


def cross_base_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.cross_base_typos(_stats(spark, sf_dir))


def time_decay_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.decayed_weights(d.entries(spark, sf_dir), d.NOW)
    return rows.select("history_id", "command", F.round("weight", 6).alias("weight"))


def rare_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = stats.decayed_weights(d.entries(spark, sf_dir), d.NOW)
    return strategies.rare_variants(weights, SETTINGS.similarity, SETTINGS.rare_threshold)


def secret_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.secrets(_stats(spark, sf_dir))


def all_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removals(spark, sf_dir)


def removal_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.reason_counts(_removals(spark, sf_dir))


def removal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.histogram(_removals(spark, sf_dir))


def reason_samples_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.reason_samples(_removals(spark, sf_dir))


def cleaned_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("history_id", "entry_id", "ts", "command")


def kept_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.kept_timestamps(_kept(spark, sf_dir))


def compacted_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.compact_exits(d.exits(spark, sf_dir), _kept(spark, sf_dir))


def allowlist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the patterns of a file that is written and read."""
    path = fresh_path(spark, "allow")
    spark.createDataFrame([(x,) for x in ("# not these", "", *ALLOW)], "value string").coalesce(1).write.text(path)
    return _removals(spark, sf_dir, history.read_allowlist(spark, path))


def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as text, a folder for each history, scanned, folded and parsed again."""
    path = fresh_path(spark, "log")
    sinks.write_histories(d.entries(spark, sf_dir), path)
    rows = history.read_history(spark, f"{path}/*", folders=True)
    name = F.regexp_extract("history_id", "history_id=([^/]*)$", 1)
    return rows.select(name.alias("history_id"), "entry_id", "raw", "ts", "command")


def exits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes appended as lines, with broken lines between them, and scanned again."""
    path = fresh_path(spark, "exits")
    rows = d.exits(spark, sf_dir)
    sinks.append_exits(rows, path)
    broken = rows.select(F.concat("ts_raw", F.when(F.col("exit_code") == 0, F.lit("")).otherwise(F.lit(":x"))).alias("value"))
    broken.write.mode("append").text(path)
    found = history.read_exits(spark, path)
    return found.groupBy("ts_raw", "exit_code").agg(F.count("*").alias("n"))


def ordered_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals in the order of a report, numbered within their history."""
    return classify.numbered(_removals(spark, sf_dir))


def explain_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.explain(d.entries(spark, sf_dir), d.exits(spark, sf_dir), _removals(spark, sf_dir), EXPLAINED)


def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    command = F.concat_ws(" ", F.lit("curl  -o"), path, "url", F.lit("v1.2.3"), F.sha1(F.col("url")), F.lit("'/tmp'  \"x\""))
    return pages.select("page_id", text.normalize(command).alias("normalized"), text.base_command(command).alias("base"))


def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.entries(spark, sf_dir)
    line = F.when(F.col("entry_id") % 7 == 0, F.col("command")).when(F.col("entry_id") % 7 == 1, F.concat(F.lit(": x"), "raw")).otherwise(
        F.concat("raw", F.lit("  "))
    )
    ts, command = history.parsed(line)
    return rows.select("history_id", "entry_id", ts.alias("ts"), command.alias("command"))


def fold_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("entry_id") % 5 == 0, "\\").when(F.col("entry_id") % 5 == 1, "\\\\").otherwise("")
    physical = d.entries(spark, sf_dir).select("history_id", F.col("entry_id").alias("line_no"), F.concat("raw", tail).alias("line"))
    return history.fold(physical).select("history_id", "entry_id", "raw", "text")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", strategies.secret_name(F.col("text")).alias("name"))
    return docs.where("name is not null")


def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.truncate("text").alias("text"))


def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all parts' names and types."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    return parts.select("p_partkey", distance.damerau_levenshtein("p_name", "p_type").cast("bigint").alias("distance"))


def tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell words of every page's command, with its quotes, escapes and an open quote at its end."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    command = F.concat(F.lit("""curl\t-o  'a b'"c\\"d" """), "url", F.lit(""" x\\ y "" '"""), "page_id")
    parts = text.split_command(command)
    return pages.withColumn("parts", parts).select("page_id", "parts.head", "parts.rest")


def run_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each history's run, written as JSON lines, read again: its totals and removals."""
    path = fresh_path(spark, "runs")
    found = _removals(spark, sf_dir)
    runs = sinks.run_rows(found, sinks.line_totals(d.entries(spark, sf_dir)), SETTINGS, True, datetime.fromtimestamp(d.NOW, UTC))
    sinks.write_runs(runs, path)
    log = spark.read.schema("value string, history_id string").text(path)
    lines = log.select("history_id", F.lit(0).alias("line_no"), F.col("value").alias("line"))
    read = history.parse_run_log(lines, "history_id")
    rows = read.select("history_id", "timestamp", "dry_run", "total_lines", "removed_count", F.size("reason_counts").alias("reasons"), F.explode("removals").alias("r"))
    return rows.select(*rows.columns[:-1], "r.line", "r.reason", "r.command")


_DOC_SECRETS = _secret_sql("text")
_TOKEN = """CASE WHEN regexp_matches(bare, '^https?://') THEN '<URL>' WHEN regexp_matches(bare, '^/') THEN '<PATH>'
 WHEN regexp_matches(bare, '^v[0-9]+\\.[0-9]+\\.[0-9]+$') THEN '<VER>' WHEN regexp_matches(bare, '^[0-9a-fA-F]{6,}$') THEN '<SHA>' ELSE tok END"""

_RAW = "CASE WHEN malformed THEN 'x' || written ELSE ': ' || second || ':0;' || written END"
_TS_RAW = "second || CASE WHEN fraction THEN '.25' ELSE '' END"

ORACLES = {
    "dedup_keep_newest": f"{d.SQL} SELECT history_id, entry_id, command FROM (SELECT *, row_number() OVER (PARTITION BY history_id, command ORDER BY entry_id DESC) AS place FROM h) WHERE place > 1",
    "dedup_documents": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS place FROM documents) WHERE place > 1",
    "command_stats": f"{d.SQL} SELECT * FROM s",
    "line_ids": f"{d.SQL} SELECT history_id, command, string_agg(CAST(entry_id AS varchar), ',' ORDER BY entry_id) AS line_ids FROM h GROUP BY ALL",
    "exit_code_join": f"{d.SQL} SELECT a.history_id, a.entry_id, CASE WHEN NOT malformed THEN second END AS ts, CASE WHEN NOT malformed THEN x.exit_code END AS exit_code FROM a LEFT JOIN x ON x.history_id = a.history_id AND x.ts = a.second",
    "base_totals": f"{d.SQL} SELECT * FROM b WHERE total >= 20",
    "failed_prefix": f"{d.SQL} {_PREFIX}",
    "failed_similar": f"{d.SQL} {_SIMILAR}",
    "cross_base_typos": f"{d.SQL} {_CROSS}",
    "time_decay_weights": f"{d.SQL} SELECT history_id, command, round(weight, 6) AS weight FROM ({_WEIGHTS})",
    "rare_variants": f"{d.SQL} {_RARE}",
    "secret_commands": f"{d.SQL} {_SECRETS}",
    "all_removals": f"{_WITH_R} SELECT * FROM r",
    "removal_reason_counts": f"{_WITH_R} SELECT history_id, reason, count(*) AS n FROM r GROUP BY ALL",
    "removal_histogram": f"{_WITH_R} SELECT reason, count(*) AS n FROM r GROUP BY ALL",
    "reason_samples_top5": f"{_WITH_R} SELECT history_id, line, reason, CASE WHEN starts_with(reason, 'Secret pattern:') THEN '<redacted>' ELSE command END AS command, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY history_id, reason ORDER BY line) AS int) AS place FROM r) WHERE place <= 5",
    "cleaned_history": f"{_WITH_K} SELECT history_id, entry_id, ts, command FROM k",
    "kept_timestamps": f"{_WITH_K} SELECT DISTINCT history_id, ts FROM k WHERE ts IS NOT NULL",
    "compacted_exits": f"{_WITH_K} SELECT history_id, max(entry_id) AS line_no, {_TS_RAW} AS ts_raw, arg_max(code, entry_id) AS exit_code FROM a WHERE (history_id, second) IN (SELECT (history_id, ts) FROM k WHERE ts IS NOT NULL) GROUP BY history_id, {_TS_RAW}",
    "allowlist_filter": f"{_WITH_R} SELECT * FROM r WHERE starts_with(reason, 'Secret pattern:') OR NOT regexp_matches(command, '^git ')",
    "explain_command": f"{_WITH_R} SELECT h.history_id, h.entry_id AS line, h.ts, h.command, s.success_count, s.failed_count, CASE WHEN r.reason IS NULL THEN 'KEEP' ELSE 'REMOVE ' || r.reason END AS verdict FROM h JOIN s USING (history_id, command) LEFT JOIN r ON r.history_id = h.history_id AND r.line = h.entry_id WHERE h.command = '{EXPLAINED}'",
    "normalize_tokens": f"""WITH c AS (SELECT page_id, concat_ws(' ', 'curl  -o', regexp_replace(url, '^https?://[^/]*', ''), url, 'v1.2.3', sha1(url), '''/tmp''  "x"') AS command FROM pages),
 t AS (SELECT page_id, i, tok, CASE WHEN length(tok) >= 2 AND left(tok, 1) = right(tok, 1) AND left(tok, 1) IN ('"', '''') THEN tok[2:-2] ELSE tok END AS bare
  FROM (SELECT page_id, unnest(regexp_extract_all(command, '\\S+')) AS tok, generate_subscripts(regexp_extract_all(command, '\\S+'), 1) AS i FROM c))
 SELECT page_id, string_agg({_TOKEN}, ' ' ORDER BY i) AS normalized, 'curl' AS base FROM t GROUP BY page_id""",
    "parse_lines": f"{d.SQL} SELECT history_id, entry_id, CASE WHEN entry_id % 7 > 1 AND NOT malformed THEN second END AS ts, CASE WHEN entry_id % 7 > 1 AND NOT malformed THEN written END AS command FROM a",
    "fold_multiline": f"""{d.SQL}, l AS (SELECT history_id, entry_id AS line_no, {_RAW} AS line, entry_id % 5 = 0 AS goes_on, CASE entry_id % 5 WHEN 1 THEN '\\\\' ELSE '' END AS tail FROM a),
 f AS (SELECT *, coalesce(NOT lag(goes_on) OVER w, true) AS begins, lead(line_no) OVER w IS NULL AS last FROM l WINDOW w AS (PARTITION BY history_id ORDER BY line_no)),
 g AS (SELECT *, CAST(sum(begins::INT) OVER (PARTITION BY history_id ORDER BY line_no) - 1 AS bigint) AS entry_id FROM f)
 SELECT history_id, entry_id, string_agg(line || CASE WHEN goes_on THEN '\\' ELSE tail END, chr(10) ORDER BY line_no) AS raw,
  string_agg(line || CASE WHEN goes_on AND last THEN '\\' WHEN goes_on THEN '' ELSE tail END, chr(10) ORDER BY line_no) AS text FROM g GROUP BY ALL""",
    "secret_scan": f"SELECT * FROM (SELECT doc_id, {_DOC_SECRETS} AS name FROM documents) WHERE name IS NOT NULL",
    "truncate_text": "SELECT doc_id, CASE WHEN length(text) <= 70 THEN text ELSE left(text, 67) || '...' END AS text FROM documents",
    "edit_distance": "SELECT p_partkey, damerau_levenshtein(p_name, p_type) AS distance FROM part",
    "tokenizer": "SELECT page_id, 'curl -o' AS head, 'a bc\"d ' || url || ' x y  ' || page_id AS rest FROM pages",
    "log_roundtrip": f"{d.SQL} SELECT history_id, row_number() OVER (PARTITION BY history_id ORDER BY entry_id) - 1 AS entry_id, {_RAW} AS raw, CASE WHEN NOT malformed THEN second END AS ts, CASE WHEN NOT malformed THEN written END AS command FROM a",
    "exits_roundtrip": f"{d.SQL} SELECT {_TS_RAW} AS ts_raw, code AS exit_code, count(*) AS n FROM a GROUP BY ALL",
    "ordered_removals": f"{_WITH_R} SELECT *, CAST(row_number() OVER (PARTITION BY history_id ORDER BY line) AS int) AS place FROM r",
    "run_log_roundtrip": f"""{_WITH_R}, g AS (SELECT history_id, count(*) AS removed_count, CAST(count(DISTINCT reason) AS int) AS reasons FROM r GROUP BY history_id),
 n AS (SELECT history_id, count(*) AS total_lines FROM a GROUP BY history_id)
 SELECT history_id, strftime(make_timestamp({d.NOW}000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, true AS dry_run, total_lines, removed_count, reasons, line, reason,
  CASE WHEN starts_with(reason, 'Secret pattern:') THEN '<redacted>' ELSE command END AS command FROM r JOIN g USING (history_id) JOIN n USING (history_id)""",
}

QUERIES = (
    dedup_keep_newest, dedup_documents, command_stats, line_ids, exit_code_join, base_totals, failed_prefix, failed_similar,
    cross_base_typos, time_decay_weights, rare_variants, secret_commands, all_removals, removal_reason_counts, removal_histogram,
    reason_samples_top5, cleaned_history, kept_timestamps, compacted_exits, allowlist_filter, explain_command, normalize_tokens,
    parse_lines, fold_multiline, secret_scan, truncate_text, edit_distance, tokenizer, run_log_roundtrip, log_roundtrip,
    exits_roundtrip, ordered_removals,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
