import os
import time

import pytest
from pyspark.sql import functions as F

from codequarry.operators.search import Filters
from codequarry.plans import editor, ingest
from codequarry.plans.lookup import Lookup, SearchRequest, format_results, revalidate
from codequarry.plans.store import IndexStore
from codequarry.sources import files
from codequarry.streaming import ingest as streams

A = "unit A;\ninterface\ntype\n  TAlpha = class\n    procedure Go;\n  end;\nimplementation\nprocedure TAlpha.Go;\nbegin\n  Beta;\nend;\nend.\n"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for name, text in {"a.pas": A, "sub/b.pas": "unit B;\ninterface\nprocedure Beta;\nimplementation\nprocedure Beta;\nbegin\nend;\nend.\n", "sub/x_TLB.pas": "unit X;", "hidden/.noindex": "", "hidden/deep/h.pas": "unit H;", "Debug/d.pas": "unit D;", "blank.pas": "  \n"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def test_listing(spark, tree):
    got = {os.path.relpath(r["path"], tree) for r in files.list_files(spark, str(tree)).collect()}
    assert got == {"a.pas", "sub/b.pas", "blank.pas"}
    assert files.scan_sources(spark, str(tree)).count() == 2


def test_incremental_equals_full(spark, tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    assert ingest.index_folder(spark, store, str(tree), dim=16)["new"] == 3
    n = store.read("symbols").count()
    assert n and store.read("vec_embeddings").count() == n
    v = store.version("symbols")
    assert ingest.index_folder(spark, store, str(tree), dim=16) == {"skipped": 3} and store.version("symbols") == v
    time.sleep(1.1)
    (tree / "sub/b.pas").write_text("unit B;\ninterface\nprocedure Gamma;\nimplementation\nprocedure Gamma;\nbegin\nend;\nend.\n")
    os.utime(tree / "sub/b.pas", (time.time() + 60, time.time() + 60))
    (tree / "a.pas").unlink()
    counts = ingest.index_folder(spark, store, str(tree), dim=16)
    assert counts["modified"] == 1 and counts["deleted"] == 1
    full = IndexStore(spark, str(tmp_path / "full"))
    ingest.index_folder(spark, full, str(tree), dim=16)
    cols = ["id", "full_name", "type", "content_hash", "start_line"]
    assert sorted(map(tuple, store.read("symbols").select(cols).collect())) == sorted(map(tuple, full.read("symbols").select(cols).collect()))
    assert store.read("vec_embeddings").count() == full.read("vec_embeddings").count()


def test_lookup_cache_and_editor(spark, tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    ingest.index_folder(spark, store, str(tree), dim=16)
    look = Lookup(spark, store, 16)
    got = look.run(SearchRequest("TAlpha", n=3, filters=Filters(content_type="code"), semantic=True))
    assert got[0]["name"] == "TAlpha" and got[0]["is_exact"]
    again = look.run(SearchRequest("TAlpha", n=3, filters=Filters(content_type="code"), semantic=True))
    assert [r["id"] for r in again] == [r["id"] for r in got]
    log = store.read("query_log").orderBy("executed_at").collect()
    assert [r["cache_hit"] for r in log] == [False, True] and store.read("query_cache").first()["hit_count"] == 2
    assert look.run(SearchRequest("qqqq zzzz")) == [] and look.run(SearchRequest("qqqq zzzz")) == []
    with pytest.raises(ValueError):
        SearchRequest(" x ").checked()
    assert SearchRequest("ab", n=0).checked().n == 1 and SearchRequest("ab", n=1).hash() != SearchRequest("ab", n=2).hash()
    s = store.read("symbols").withColumn("implemented_interfaces", F.array_join("implemented_interfaces", ","))
    fine = revalidate(store.read("query_cache"), s, store.read("query_log"))
    assert fine.where("cache_valid").count() == 2 and revalidate(store.read("query_cache"), s.limit(0), None).where("cache_valid").count() == 1
    q = editor.at_position(spark, "  x := TAlpha.Create", 8)
    assert editor.definition(q, s).first()["range"]["start"]["line"] == 3
    assert "TAlpha" in editor.hover(q, s).first()["markdown"] and editor.at_position(spark, "  ", 0).count() == 0
    assert editor.document_symbols(s, str(tree / "a.pas")).count() >= 2
    shown = format_results(s.withColumn("score", F.lit(1.0)).withColumn("match_type", F.lit("x"))).first()["shown"]
    assert "Relevance: 1.00 (x)" in shown


def test_buckets_and_reindex(spark, tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"), buckets=8)
    ingest.index_folder(spark, store, str(tree / "sub"), dim=16, category="stdlib")
    ingest.index_folder(spark, store, str(tree), dim=16)
    before = store._now("symbols")["buckets"]
    (tree / "sub/c.pas").write_text("unit C;\ninterface\nprocedure Delta;\nimplementation\nprocedure Delta;\nbegin\nend;\nend.\n")
    got = ingest.reindex(spark, store, dim=16)
    assert list(got) == [str(tree)] and got[str(tree)]["new"] == 1
    after = store._now("symbols")["buckets"]
    assert sum(before.get(b) != v for b, v in after.items()) == 1  # one file, one bucket
    assert store.read("vec_embeddings").count() == store.read("symbols").count()
    assert store.read("symbols").where("name = 'Delta'").count() == 2 and store.update("packages", lambda d: d) == 0
    files_ = spark.createDataFrame([(None, None)], "file_path string, file_hash string")
    store.replace("indexed_files", store.read("indexed_files").selectExpr("lower(file_path) file_key"), files_)
    assert [r["file_path"] for r in store.read("indexed_files").collect()] == [None]
    import shutil

    shutil.rmtree(tree)
    assert list(ingest.reindex(spark, store).values()) == [{}]


def test_services_that_fail(spark, tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    ingest.index_folder(spark, store, str(tree), dim=16)

    def broken(*_):
        raise ConnectionError("no service")

    look = Lookup(spark, store, 16, embed=broken, scorer=broken)
    got = look.run(SearchRequest("alpha", n=2, semantic=True, reranked=True))
    assert got and len(got) <= 2 and len(look.warnings) == 2
    fine = Lookup(spark, store, 16)
    assert fine.vector("alpha") is fine.vector("alpha")
    wrong = Lookup(spark, store, 8, embed=lambda d, c, n: ingest.embed_column(d, c, 16))
    with pytest.raises(ValueError):
        wrong.vector("alpha")


def test_state_files_are_written_once(spark, tmp_path):
    from codequarry.streaming.changelog import Store

    s = Store(spark, str(tmp_path / "state"))
    s.put("plan-1", {"a": 1})
    with pytest.raises(FileExistsError):
        s.put("plan-1", {"a": 2})
    for i in range(5):
        s.write("x.json", {"i": i})
    assert s.read("plan-1") == {"a": 1} and s.read("x.json") == {"i": 4} and s.read("none") is None
    assert len([n for n in s.names() if n.startswith("x.json")]) == 2 and not any(n.startswith(".plan") for n in s.names())


def test_packages(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "Core.dpk").write_text("package Core; requires rtl; contains A in 'a.pas'; end.")
    (root / "Ui.dpk").write_text("package Ui; requires Core, vcl; end.")
    store = IndexStore(spark, str(tmp_path / "ix"))
    ingest.index_packages(spark, store, str(root))
    assert {r["package_name"]: r["framework"] for r in store.read("packages").collect()} == {"Core": "RTL", "Ui": "VCL"}
    assert store.read("package_files").first()["file_path"] == "a.pas"


def test_streams(spark, tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"))
    for _ in range(2):  # the second run finds nothing new
        streams.ingest(streams.file_stream(spark, str(tree / "sub"), "b.pas"), store, str(tmp_path / "cp")).awaitTermination()
    assert {r["name"] for r in store.read("symbols").collect()} == {"Beta"} and store.version("symbols") == 1


def test_migration(spark):
    from codequarry import schema

    h = spark.createDataFrame([("c:/a/x.pas", "h")], "file_path string, file_hash string")
    f = spark.createDataFrame([("C:\\a",)], "folder_path string")
    s = spark.createDataFrame([(1, "x, y", '["p"]')], "id long, domain_tags string, spanish_terms string")
    out = schema.migrate({"file_hashes": h, "indexed_folders": f, "symbols": s}, 1)
    assert out["indexed_files"].first()["folder_path"] == "C:\\a" and out["symbols"].first()["domain_tags"] == ["x", "y"] and out["symbols"].first()["spanish_terms"] == ["p"]
