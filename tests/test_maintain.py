import random
from datetime import datetime

from pyspark.sql import functions as F

from codequarry.operators import analytics, intel, maintain


def test_merkle_ignores_order_and_sees_deep_edits(spark):
    rows = [("r/a/x.pas", "1"), ("r/a/y.pas", "2"), ("r/b/c/d/z.pas", "3"), ("r/w.pas", None)]
    base = {r["folder"]: r["hash"] for r in maintain.merkle(spark.createDataFrame(rows, "path string, hash string")).collect()}
    random.Random(1).shuffle(rows)
    assert base == {r["folder"]: r["hash"] for r in maintain.merkle(spark.createDataFrame(rows, "path string, hash string")).collect()}
    rows = [(p, "9" if p.endswith("z.pas") else h) for p, h in rows]
    after = maintain.merkle(spark.createDataFrame(rows, "path string, hash string"))
    before = spark.createDataFrame(list(base.items()), "folder string, hash string")
    assert {(r["folder"], r["status"]) for r in maintain.changed_folders(before, after).collect()} == {(f, "changed") for f in ("r", "r/b", "r/b/c", "r/b/c/d")}
    assert maintain.merkle(spark.createDataFrame([], "path string, hash string")).count() == 0


def test_file_status(spark):
    cur = spark.createDataFrame([("new", "h", 1), ("same", "H", 9), ("mod", "h2", 9), ("touch", "x", 3), ("unread", None, 9)], "file_key string, file_hash string, modified_at int")
    old = spark.createDataFrame([("same", "h", 5), ("mod", "h", 5), ("touch", "y", 5), ("unread", "h", 5), ("gone", "h", 5)], "file_key string, stored_hash string, indexed_at int")
    got = {r["file_key"]: r["status"] for r in maintain.file_status(cur, old).collect()}
    assert got == {"new": "new", "same": "unchanged", "mod": "modified", "touch": "skipped", "unread": "modified", "gone": "deleted"}


def test_upserts_and_cascades(spark):
    s = spark.createDataFrame([(1, "a", "C:\\F\\x.pas", "t", 1), (2, "a", "C:\\F\\x.pas", "t", 2), (3, None, "c:/fa/y.pas", None, 1), (4, None, None, None, 1)], "id long, name string, file_path string, type string, created_at int")
    assert {r["id"] for r in maintain.upsert_latest(s, maintain.LEGACY_KEY, ["created_at", "id"]).collect()} == {2, 3, 4}
    v = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 99)], "vec_id long, symbol_id long")
    left, vec = maintain.cascade_delete(s, v, spark.createDataFrame([("c:/f/x.pas",)], "file_key string"))
    assert {r["id"] for r in left.collect()} == {3, 4} and {r["vec_id"] for r in vec.collect()} == {2, 3, 4}
    assert {r["id"] for r in maintain.outside_folder(s, "C:/f/").collect()} == {3, 4}
    assert {r["vec_id"] for r in maintain.orphans(v, s).collect()} == {3, 4}


def test_longest_prefix_respects_folder_names(spark):
    files = spark.createDataFrame([("C:\\a\\bc\\x.pas",), ("c:/a/b/c/x.pas",), ("z.pas",), (None,)], "file_path string")
    folders = spark.createDataFrame([("C:/A/b",), ("c:\\a\\",), (None,)], "folder_path string")
    got = {r["file_path"]: r["folder_path"] for r in maintain.longest_prefix(files, folders).collect()}
    assert got == {"C:\\a\\bc\\x.pas": "c:\\a\\", "c:/a/b/c/x.pas": "C:/A/b", "z.pas": ""}


def test_cache_validation(spark):
    s = spark.createDataFrame([(1, "h1"), (2, None)], "id long, content_hash string")
    c = spark.createDataFrame([("ok", "1:H1, 1", 2), ("gone", "1:h1,9", 2), ("changed", "1:x", 1), ("none", "", 0), ("lost", None, 3), ("zero", "0", 1), ("bad", "abc", 1), ("nohash", "2:zz", 1)], "query_hash string, result_ids string, result_count int")
    got = {r["query_hash"]: r["still_valid"] for r in maintain.validate_cache(c, s).collect()}
    assert got == {"ok": True, "gone": False, "changed": False, "none": True, "lost": False, "zero": False, "bad": False, "nohash": False}


def test_empty_log_and_running_means(spark):
    log = spark.createDataFrame([], "cache_hit boolean, exact_match boolean, result_count int, duration_ms double")
    r = analytics.log_stats(log).first()
    assert r["n_queries"] == 0 and r["cache_hits"] == 0 and r["avg_ms"] is None and r["hit_percent"] == 0.0
    cache = spark.createDataFrame([("a", 2, 3), ("b", 1, 7)], "query_hash string, hit_count long, avg_ms long")
    batch = spark.createDataFrame([("a", 8), ("c", 5)], "query_hash string, duration_ms long")
    got = {r["query_hash"]: (r["hit_count"], r["avg_ms"]) for r in analytics.upsert_cache(cache, batch).collect()}
    assert got == {"a": (3, 4), "b": (1, 7), "c": (1, 5)}


def test_log_to_cache_takes_latest_of_all(spark):
    t = lambda d: datetime(2024, 1, d)
    log = spark.createDataFrame([(1, t(1), "q", "h", "r1", True, 10.0), (2, t(3), "q", "h", "r2", False, 90.0), (3, t(3), "q", "h", "r3", False, 1.0)], "log_id long, executed_at timestamp, query_text string, query_hash string, result_ids string, cache_valid boolean, duration_ms double")
    r = analytics.log_to_cache(log).first()
    assert (r["result_ids"], r["hit_count"], r["avg_ms"]) == ("r3", 1, 10.0)
    kept = analytics.retained(log, F.expr("timestamp'2024-02-01'"), 29)
    assert {x["log_id"] for x in kept.collect()} == {1, 2, 3} and analytics.retained(log, F.expr("timestamp'2024-03-01'"), 29).count() == 1


def test_framework_tiers(spark):
    files = spark.createDataFrame([("a.pas", "// framework: rtl\nuses Forms;"), ("b.pas", "uses Windows, Vcl.Graphics;"), ("c.pas", "uses { Forms } SysUtils in 'x';"), ("s\\source\\fmx\\d.pas", "unit d;"), ("e.pas", "unit e;"), ("m.pas", "uses FMX.Types, Forms;")], "file_path string, content string")
    ov = spark.createDataFrame([(0, None, "m*.pas", "VCL"), (1, "M.PAS", None, "RTL")], "ordinal int, file string, pattern string, framework string")
    pk = spark.createDataFrame([("m.pas", "FMX"), ("c.pas", "RTL")], "file_key string, package_framework string")
    got = {r["file_path"]: (r["framework"], r["tier"], r["warning"]) for r in intel.detect(files, ov, pk).collect()}
    assert got["a.pas"] == ("RTL", "tag", "comment_vs_uses") and got["b.pas"] == ("VCL", "uses", "orphaned_file") and got["c.pas"] == ("RTL", "package", None)
    assert got["s\\source\\fmx\\d.pas"] == ("FMX", "folder", None) and got["e.pas"] == ("", "unknown", "unknown_framework") and got["m.pas"] == ("VCL", "mapping", "mapping_vs_package")


def test_reach_with_circles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a"), ("x", None)], "src string, dst string")
    assert {(r["src"], r["dst"]) for r in intel.reach(e).collect()} == {(s, d) for s in "abc" for d in "abcd"}
    t = intel.transitive_uses(e.where("src is not null and dst is not null"), spark.createDataFrame([("a",)], "root string"))
    assert {(r["unit"], r["distance"]) for r in t.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_glossary(spark):
    g = spark.createDataFrame([("factura", ["invoice"], ["billing"]), ("cierre de mes", ["month end"], ["acc", "billing"])], "term string, english array<string>, tags array<string>")
    t = spark.createDataFrame([(1, "Facturas al CIERRE de mes"), (2, "prefactura"), (3, None)], "id long, t string")
    got = {r["id"]: (r["spanish_terms"], r["domain_tags"], r["n_terms"]) for r in intel.enrich(t, "id", "t", g).collect()}
    assert got == {1: ('["cierre de mes","factura"]', "acc,billing", 2), 2: ("[]", "", 0), 3: ("[]", "", 0)}


def test_orphan_mappings_round_trip(spark, tmp_path):
    from codequarry.sources import files

    detected = spark.createDataFrame([("C:\\b.pas", "VCL", "uses", None), ("c:/a.pas", "RTL", "folder", None), ("x", "RTL", "tag", None)], "file_path string, framework string, tier string, warning string")
    ov = spark.createDataFrame([(3, "x", None, "RTL")], "ordinal int, file string, pattern string, framework string")
    new = intel.orphan_mappings(detected, ov)
    assert [(r["ordinal"], r["file"]) for r in new.orderBy("ordinal").collect()] == [(4, "C:/b.pas"), (5, "c:/a.pas")]
    files.write_overrides(new, str(tmp_path / "m.json"))
    back = files.overrides(spark, str(tmp_path / "m.json")).collect()
    assert [(r["ordinal"], r["file"], r["framework"], r["pattern"]) for r in back] == [(0, "C:/b.pas", "VCL", None), (1, "c:/a.pas", "RTL", None)]


def test_reports(spark):
    p = spark.createDataFrame([("b", "VCL", None), ("a", "RTL", "x")], "package_name string, framework string, category string")
    f = spark.createDataFrame([("b", "f1"), ("b", "f2")], "package_name string, file_path string")
    assert [(r["package_name"], r["files"]) for r in analytics.package_report(p, f).collect()] == [("a", 0), ("b", 2)]
    c = spark.createDataFrame([("x", 1), ("y", 5), ("z", None)], "query_hash string, hit_count long")
    assert [r["query_hash"] for r in analytics.cache_report(c).collect()] == ["y", "x", "z"]
    d = spark.createDataFrame([("a", datetime(2024, 1, 1), 1, 10, 4), ("b", datetime(2024, 1, 2), 1, 10, 0)], "folder_path string, indexed_at timestamp, files_count int, chunks_count int, duration_seconds int")
    assert [(r["folder_path"], r["per_second"]) for r in analytics.folder_report(d).collect()] == [("b", None), ("a", 2.5)]
    assert analytics.folder_totals(d.limit(0)).first()["files"] == 0
