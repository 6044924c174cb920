import pytest

from codequarry.operators import incremental
from codequarry.streaming.changelog import ChangeLog

SCHEMA = "k string, off long, v string"


def test_batches_replay_and_late_rows(spark, tmp_path):
    root = str(tmp_path / "log")
    log = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z"), ("c", None, "lost")], SCHEMA)
    cl = ChangeLog(spark, root, "k", "off", 4)
    assert cl.run(log, lambda d: d) == 0
    assert cl.run(log, lambda d: d) is None  # nothing new
    more = log.union(spark.createDataFrame([("a", 7, "n"), ("d", 5, "m")], SCHEMA))

    def fails(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        cl.run(more, fails)
    # what comes after the plan isn't in the replay, which keeps the plan
    later = more.union(spark.createDataFrame([("e", 9, "late")], SCHEMA))
    n, plan = ChangeLog(spark, root, "k", "off", 4).plan(later)
    assert n == 1 and 9 not in plan["to"].values()
    assert ChangeLog(spark, root, "k", "off", 4).run(later, lambda d: d) == 1
    assert cl.run(later, lambda d: d) == 2
    got = sorted((r["k"] or "", r["off"]) for r in cl.sink().collect())
    assert got == [("", 3), ("a", 1), ("a", 7), ("b", 2), ("d", 5), ("e", 9)]


def test_half_written_sink_is_replaced(spark, tmp_path):
    root = str(tmp_path / "log")
    log = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x")], SCHEMA)
    cl = ChangeLog(spark, root, "k", "off", 2)
    cl.plan(log)
    log.write.parquet(f"{root}/sink/batch=0")  # an attempt that died before its commit
    with pytest.raises(FileNotFoundError):
        cl.sink()
    cl.run(log, lambda d: d)
    assert cl.sink().count() == 1


def test_changed_files_and_stale_symbols(spark):
    scan = spark.createDataFrame([(1, "C:\\A.pas", "H1", 5), (2, "c:/a.pas/", "h2", 5), (3, "b.pas", None, 9), (4, "b.pas", "hb", 8), (5, None, "x", 1), (6, "new.pas", "n", 1)], "scan_seq long, file_path string, file_hash string, scanned_at int")
    hashes = spark.createDataFrame([("c:\\A.PAS", " H2 ", 3, 1), ("c:/a.pas", "old", 9, 2), ("b.pas", "zz", 1, 1)], "file_path string, file_hash string, last_indexed int, run_id long")
    runs = spark.createDataFrame([(1, " SUCCESS"), (2, "failed"), (1, "success")], "run_id long, status string")
    got = incremental.changed_files(incremental.latest_sightings(scan), incremental.recorded_hashes(hashes, runs))
    assert [r["scan_seq"] for r in got.collect()] == [6]
    s = spark.createDataFrame([(1, "x", "9DD4E461268C8034F5C8564E155C67A6"), (2, "x", "bad"), (3, "x", None), (4, "x", " "), (5, None, "d41d8cd98f00b204e9800998ecf8427e")], "id long, content string, content_hash string")
    assert sorted(r["id"] for r in incremental.stale_symbols(s).collect()) == [2, 3, 4]
    assert incremental.changed_files(incremental.latest_sightings(scan.limit(0)), incremental.recorded_hashes(hashes, runs)).count() == 0
