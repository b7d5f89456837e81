import json
import stat

import pytest

from logsieve.plans import cleanup
from logsieve.sources import history, sinks
from logsieve.streaming import exits as streaming


@pytest.fixture
def files(tmp_path):
    return cleanup.Files(tmp_path / "log", tmp_path / "exits", tmp_path / "allow", tmp_path / "runs")


def write(files, text, exits=""):
    files.history.write_text(text)
    files.exits.write_text(exits)


NOW = 1_700_000_000
LOG = ": 11:0;df -h\n: 12:4;free -m\n: 13:0;df -h\nno entry\n: 14:0;cat <<X \\\nbody\n"


def test_dry_run_only_writes_the_run_log(spark, files):
    write(files, LOG, "11:0\n99:0\n")
    report = cleanup.run(spark, files, dry_run=True, now=NOW)
    assert (files.history.read_text(), files.exits.read_text()) == (LOG, "11:0\n99:0\n")
    run = json.loads(files.log.read_text())
    assert (run["dry_run"], run["total_lines"], run["removed_count"]) == (True, 5, 1)
    assert report.removals.count() == 1 and report.total_lines == 5


def test_a_run_and_its_undoing(spark, files):
    """The older of equal commands goes; malformed and folded lines stay as they were; only exits of kept seconds stay."""
    write(files, LOG, "11:0\n12.5:1\n12.5:0\n13:0\n99:0\n")
    cleanup.run(spark, files, now=NOW)
    assert files.history.read_text() == LOG.partition("\n")[2]
    assert files.exits.read_text() == "12.5:0\n13:0\n"
    assert {stat.S_IMODE(f.stat().st_mode) for f in (files.history, files.exits)} == {0o600}
    cleanup.undo(files)
    assert files.history.read_text() == LOG


def test_a_clean_log_is_left_alone(spark, files):
    write(files, ": 21:0;id\n")
    cleanup.run(spark, files, now=NOW)
    run = json.loads(files.log.read_text())
    assert (run["removed_count"], run["removals"], run["reason_counts"], run["total_lines"]) == (0, [], {}, 1)
    assert not sinks.backups(files.history)


def test_appended_exits(spark, tmp_path):
    rows = [("h", 0, "5.25", 1), ("h", 1, "6", 0)]
    for part in rows:
        sinks.append_exits(spark.createDataFrame([part], "history_id string, line_no bigint, ts_raw string, exit_code int"), str(tmp_path / "x"))
    found = history.read_exits(spark, str(tmp_path / "x"))
    assert {(r.ts_raw, r.exit_code) for r in found.collect()} == {("5.25", 1), ("6", 0)}


def test_log_hides_secrets_and_is_read(spark, files):
    secret = "glab auth --token glpat-" + "Q7" * 12
    write(files, f": 1:0;{secret}\n: 2:0;date\n: 3:0;date\n")
    cleanup.run(spark, files, now=NOW)
    run = json.loads(files.log.read_text())
    assert secret not in files.log.read_text()
    assert run["reason_counts"] == {"Duplicate": 1, "Secret pattern: GitLab token": 1}
    assert stat.S_IMODE(files.log.stat().st_mode) == 0o600
    files.log.write_text(files.log.read_text() + "[x] ERROR not json\n")
    rows = history.read_run_log(spark, str(files.log)).collect()
    assert len(rows) == 1 and rows[0].total_lines == 3
    assert [s.command for s in rows[0].samples] == ["<redacted>"]


def test_rotation_and_retention(tmp_path):
    log = tmp_path / "runs"
    sinks.append_run(log, "a" * 20, 10)
    sinks.append_run(log, "b", 10)
    assert (tmp_path / "runs.1").read_text() == "a" * 20 + "\n" and log.read_text() == "b\n"
    path = tmp_path / "log"
    path.write_text("x")
    for i in range(7):
        (tmp_path / f"log.backup-2024010{i}-000000").write_text("old")
    from datetime import datetime

    sinks.back_up(path, datetime(2024, 2, 1))
    assert len(sinks.backups(path)) == 5
    with pytest.raises(FileNotFoundError):
        sinks.restore(tmp_path / "other")


def test_explain(spark, files):
    write(files, ": 1:0;date\n: 2:0;date\n", "1:0\n")
    rows = cleanup.explain(spark, files, "date", now=NOW).collect()
    assert [r.verdict for r in rows] == ["REMOVE Duplicate", "KEEP"]
    with pytest.raises(LookupError):
        cleanup.explain(spark, files, "none", now=NOW)
    cleanup.record_exit(files, "2", 1)
    assert files.exits.read_text() == "1:0\n2:1\n"


def test_written_histories(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 0, "w"), ("b", 0, "y")], "history_id string, entry_id bigint, raw string")
    sinks.write_histories(rows, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out/history_id=a").glob("part-*"))) == "w\nx\n"


def test_exit_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("1:0\nbad\n2:1\n")
    stream = streaming.read_exit_stream(spark, str(tmp_path / "in"))
    streaming.append_table(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert {(r.ts_raw, r.exit_code) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("1", 0), ("2", 1)}
    rates = streaming.failure_rates(streaming.read_exit_stream(spark, str(tmp_path / "in")))
    query = rates.writeStream.format("memory").queryName("rates").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.runs, r.failures) for r in spark.table("rates").collect()] == [(2, 1)]
