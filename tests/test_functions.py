import math

from pyspark.sql import functions as F

from codequarry.functions import text


def one(spark, c, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {t}" for k, t in zip(cols, ["string"] * len(cols))))
    return df.select(c.alias("x")).first()["x"]


def test_keywords_and_similarity(spark):
    assert one(spark, text.extract_keywords(F.col("a")), a="niño café x_1 Foo foo ab") == ["caf", "foo", "x_1"]
    assert one(spark, text.text_similarity(F.col("a"), F.col("b")), a="foo bar", b="the FOO BAR is") == 1.0
    assert one(spark, text.text_similarity(F.col("a"), F.col("b")), a="foo bar", b="foo") == 0.25
    assert one(spark, text.text_similarity(F.col("a"), F.col("b")), a=None, b="foo") == 0.0
    assert one(spark, text.text_similarity(F.col("a"), F.col("b")), a="", b="foo") == 0.0


def test_queries(spark):
    assert one(spark, text.sanitize_query(F.col("a")), a="  it's;  \"x\"  y ") == "its x y"
    assert one(spark, text.valid_query(F.col("a")), a=" a ") is False and one(spark, text.valid_query(F.col("a")), a="ab") is True
    assert one(spark, text.valid_query(F.col("a")), a=None) is False
    assert one(spark, text.ordered_pattern(F.col("a")), a="zebra max_row apple") == "%apple%max\\_row%zebra%"
    assert one(spark, text.ordered_pattern(F.col("a")), a="a b") is None
    assert one(spark, text.looks_like_identifier(F.col("a")), a="TStringList") and not one(spark, text.looks_like_identifier(F.col("a")), a="parse pascal code")


def test_globs(spark):
    m = lambda g, p: one(spark, F.rlike(F.col("a"), text.glob_to_regex(F.col("b"))), a=p, b=g)
    assert m("**/*.pas", "C:/x/y.PAS") and not m("*.pas", "x/y.pas") and m("a.b*", "a.bc") and not m("a.b*", "axbc")
    assert m("x(1)+.pas", "x(1)+.pas") and m("?.pas", "y.pas") and not m("?.pas", "yy.pas")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [tuple(r) for r in df.select(text.cosine_distance(F.col("a"), F.col("b")), text.l2_distance(F.col("a"), F.col("b"))).collect()]
    assert got[0][0] == 1.0 and math.isclose(got[0][1], math.sqrt(5)) and abs(got[1][0]) < 1e-12 and got[2][0] is None and got[3] == (None, None)
    v = spark.createDataFrame([([1.0, 2.0, 3.0],), (None,)], "v array<float>").select(text.fit_vector(F.col("v"), 2).alias("p"), text.fit_vector(F.col("v"), 4).alias("q")).collect()
    assert v[0]["p"] == [1.0, 2.0] and v[0]["q"] == [1.0, 2.0, 3.0, 0.0] and v[1]["p"] == [0.0, 0.0]


def test_formatting(spark):
    assert one(spark, text.clean_whitespace(F.col("a")), a="\tx   y  \r\n z") == "  x y\n z"
    assert one(spark, text.first_lines(F.col("a"), 2), a="1\n2\n3\n4") == "1\n2\n... (2 more lines)"
    assert one(spark, text.uri_to_path(text.path_to_uri(F.col("a"))), a="C:\\a b\\c#1+2.pas") == "C:/a b/c#1+2.pas"
    assert one(spark, text.uri_to_path(text.path_to_uri(F.col("a"))), a="/mnt/ü%x.pas") == "/mnt/ü%x.pas"


def test_sql_functions(spark):
    text.register(spark)
    r = spark.sql("SELECT text_similarity('foo bar', 'the foo bar') AS s, extract_keywords('Foo bar x') AS k, distance_to_score(0.5D) AS d, sanitize_query(' a;  b ') AS q").first()
    assert r["s"] == 1.0 and r["k"] == ["bar", "foo"] and r["d"] == 0.75 and r["q"] == "a b"


def test_enums_urls_and_json(spark):
    from codequarry.functions import text
    from codequarry.operators import intel, parser, search

    c = F.col
    rows = [("VCL", "linux, WINDOWS,x,,linux", "http://h/", "Local", "getName"), (None, None, None, None, None), ("zz", "", "http://h:80", "local", "a.b"), ("BOTH", "ios", "https://h", "other", "")]
    d = spark.createDataFrame(rows, "fw string, p string, url string, prov string, name string")
    got = d.select(text.doc_framework_of(c("fw")), text.platform_set(c("p")), text.service_url(c("url"), c("prov"), "local", 11434), text.name_matches(c("name"), F.array(F.lit("GET*me"), F.lit("*.b")))).collect()
    assert [tuple(r) for r in got] == [("VCL", ["Windows", "Linux"], "http://h:11434", True), ("none", [], None, False), ("none", [], "http://h:80", True), ("both", ["iOS"], "https://h", False)]
    j = spark.range(1).select(text.page_json(F.lit("A.B"), F.lit("B"), F.lit("Class"), F.lit(None), F.lit(""), F.lit("A"), F.lit("linux"), F.lit(True), F.lit("Q"))).first()[0]
    assert j == '{"name":"A.B","shortName":"B","type":"class","framework":"none","unit":"A","platforms":"Linux","inherited":true,"inheritedFrom":"Q"}'
    o = spark.createDataFrame([(0, "C:/a.pas", None, "VCL", "r"), (4, None, "**/n*.pas", "FMX", "r")], "ordinal int, file string, pattern string, framework string, reason string")
    f = spark.createDataFrame([("c:\\A.PAS",), ("x/y/n1.pas",), ("z.pas",)], "file_path string")
    assert {r[0]: r[1] for r in intel.in_overrides(f, o).collect()} == {"c:\\A.PAS": True, "x/y/n1.pas": True, "z.pas": False}
    more = intel.add_override(o, "RTL", "why", pattern="*.pas")
    assert more.where("ordinal = 5").first()["pattern"] == "*.pas"
    assert spark.range(1).select(intel.expand_abbreviations(F.lit("a Proc and process"), {"proc": "procedure"})).first()[0] == "a procedure and process"
    s = spark.createDataFrame([(2, "Foo", "T.Foo", "Class"), (1, "x", "FOO", "var")], "id long, name string, full_name string, type string")
    assert [r["id"] for r in search.chunks_by_name(s, "foo").collect()] == [1, 2] and search.chunks_by_type(s, "CLASS").count() == 1
    p = parser.parse_units(spark.createDataFrame([(f"f{i}", "") for i in range(12)] + [("ok", "unit A; interface const c = 1; implementation end.")], "path string, text string"))
    report = {r["parse_status"]: (r["files"], len(r["first_files"])) for r in parser.parse_report(p).collect()}
    assert report["failed"] == (12, 10) and report["parsed"] == (1, 1)


def test_glossary_file(spark, tmp_path):
    from codequarry.operators import intel

    (tmp_path / "g.json").write_text('[{"term": "pedido", "english": ["order"], "domain_tags": ["sales"]}, {"term": " pedido", "domain_tags": ["b"]}, {"term": ""}, {"english": ["x"]}]')
    assert [tuple(r) for r in intel.load_glossary(spark, str(tmp_path / "g.json")).collect()] == [("pedido", ["order"], ["b", "sales"])]
