import hashlib

import pytest

from codequarry.operators import incremental
from codequarry.streaming.changelog import ChangeLog

SCAN = "scan_seq long, file_path string, file_hash string, scanned_at int"
SYMBOLS = "id long, content string, content_hash string"


def fine(i, text):
    return (i, text, hashlib.md5(text.encode()).hexdigest())


def test_edits_in_place_repairs_and_failed_runs(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "kept")

    def run(rows, seqs=1):
        scan = spark.createDataFrame([(k, "a.pas", f"h{k}", k) for k in range(1, seqs + 1)], SCAN)
        files, stale = incremental.capture(spark, scan, spark.createDataFrame(rows, SYMBOLS), root)
        return sorted(r["id"] for r in stale.collect()), [r["scan_seq"] for r in files.collect()]

    rows = {i: fine(i, f"t{i}") for i in range(10, 20)} | {11: (11, "x", "bad"), 12: (12, None, " ")}
    assert run(list(rows.values())) == ([11, 12], [1])
    assert run(list(rows.values())) == ([11, 12], [1])  # nothing new
    # an edit in place, a lost hash, a repair, a row with a lower id, and one that is gone
    rows |= {13: (13, "edited", rows[13][2]), 14: (14, "t14", None), 11: fine(11, "x"), 3: (3, "low", "bad")}
    del rows[12]
    assert run(list(rows.values()), 2) == ([3, 13, 14], [2])

    # a run that fails after its plan: the next one replays it and takes what came since
    rows |= {13: fine(13, "edited"), 15: (15, "broken", "bad")}
    with monkeypatch.context() as m:
        m.setattr(ChangeLog, "rows", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            incremental.capture_symbols(spark, spark.createDataFrame(list(rows.values()), SYMBOLS), f"{root}/symbols")
    rows |= {15: fine(15, "mended"), 16: (16, "t16", "bad")}
    assert run(list(rows.values()), 3) == ([3, 14, 16], [3])
    with monkeypatch.context() as m:
        m.setattr(ChangeLog, "rows", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run(list(rows.values()), 4)  # the log of files fails
    assert run(list(rows.values()), 5) == ([3, 14, 16], [5])
    # back to a state seen before is a change too
    rows[16] = fine(16, "t16")
    assert run(list(rows.values()), 5) == ([3, 14], [5])
    rows[16] = (16, "t16", "bad")
    assert run(list(rows.values()), 5) == ([3, 14, 16], [5])
