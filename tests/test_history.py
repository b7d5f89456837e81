import tempfile
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logsieve.plans import registry
from logsieve.sources import history, sinks


def read(spark, data: bytes):
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "log")
        path.write_bytes(data)
        return history.read_history(spark, str(path)).orderBy("entry_id").collect()


def test_lines(spark):
    """Well-formed lines, and each way to be malformed: no head, no number, no command."""
    rows = read(spark, b": 88:3;date -u  \n# note\n: 8x:0;date\n: 9:0; \t \n7:;x;y")
    assert [(r.entry_id, r.ts, r.command) for r in rows] == [(0, "88", "date -u"), (1, None, None), (2, None, None), (3, None, None), (4, "7", "x;y")]
    assert [r.raw for r in rows] == [": 88:3;date -u  ", "# note", ": 8x:0;date", ": 9:0; \t ", "7:;x;y"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_folding(spark, n):
    """An odd run of backslashes joins the next line and loses its last one in the text alone."""
    rows = read(spark, b": 5:0;a" + b"\\" * n + b"\nb\n")
    tail = "\\" * n
    if n % 2:
        assert [(r.raw, r.command) for r in rows] == [(f": 5:0;a{tail}\nb", f"a{tail[1:]}\nb")]
    else:
        assert [(r.raw, r.command) for r in rows] == [(f": 5:0;a{tail}", f"a{tail}"), ("b", None)]
    assert [r.command for r in read(spark, b": 5:0;a" + b"\\" * n)] == [f"a{tail}"]


@pytest.mark.parametrize("size", [16, 40, 1 << 20])
def test_blocks_fold_like_whole_files(spark, tmp_path, size):
    """Blocks that end inside entries, lines and runs of backslashes."""
    import random

    draw = random.Random(size)
    for name in ("a", "b"):
        parts = [f": {i}:0;run {'x' * draw.randrange(9)}" + "\\" * draw.choice([0, 0, 1, 2, 3]) for i in range(60)]
        (tmp_path / name).write_text("\n".join(parts) + draw.choice(["", "\n"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        by_blocks = history.read_history(spark, str(tmp_path), blocks=True)
        found = [(r.history_id.rpartition("/")[2], *r[1:]) for r in by_blocks.orderBy("history_id", "entry_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = history.read_history(spark, str(tmp_path)).orderBy("history_id", "entry_id").collect()
    assert found == [(r.history_id.rpartition("/")[2], *r[1:]) for r in whole]


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_histories_in_several_files(spark, tmp_path, size):
    """A history that a write splits over files is one log: its entries are numbered through, and fold across blocks."""
    rows = [(h, i, f": {i}:0;run {i}" + ("\\\nmore" if i % 3 == 0 else "")) for h in ("a", "b/c") for i in range(150)]
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": str(size)}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        sinks.write_histories(spark.createDataFrame(rows, "history_id string, entry_id long, raw string"), str(tmp_path / "out"))
        found = history.read_history(spark, f"{tmp_path}/out/*", folders=True).orderBy("history_id", "entry_id").collect()
        table = registry.queries()["log_roundtrip"](spark, "/root/testdata/sf0.001")
        ids = sorted((r.history_id, r.entry_id) for r in table.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(len(list(p.glob("*.txt"))) for p in (tmp_path / "out").glob("history_id=*")) > 1
    assert [(r.entry_id, r.raw) for r in found] == [(i, raw) for _, i, raw in rows]
    assert len({r.history_id for r in found}) == 2
    assert len(set(ids)) == len(ids)


def test_invalid_bytes_and_carriage_return(spark):
    rows = read(spark, b": 1:0;a\xe2\x82b\r\n")
    assert rows[0].command == "a�b"
    assert rows[0].raw.endswith("\r")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.binary(max_size=60))
def test_any_bytes(spark, data):
    rows = read(spark, data)
    assert len(rows) <= data.count(b"\n") + 1
    assert all((r.ts is None) == (r.command is None) for r in rows)
    assert [r.entry_id for r in rows] == list(range(len(rows)))


def test_exits(spark, tmp_path):
    path = tmp_path / "exits"
    path.write_text("41:0\r\n42:130\nno colon\n43:x1\n\n44.75:-1\n45: 5\n46:+5\n47:99999999999\n")
    found = {r.ts_raw: r.exit_code for r in history.read_exits(spark, str(path)).collect()}
    assert found == {"41": 0, "42": 130, "44.75": -1, "46": 5}
    assert history.read_exits(spark, str(tmp_path / "none")).count() == 0


def test_allowlist(spark, tmp_path):
    path = tmp_path / "allow"
    path.write_text("# note\n\n^git \nls$\n")
    assert history.read_allowlist(spark, str(path)) == ["^git", "ls$"]
    for bad in ("(", "a(?=b)", "(a)\\1"):
        path.write_text(bad)
        with pytest.raises(Exception):
            history.read_allowlist(spark, str(path))
