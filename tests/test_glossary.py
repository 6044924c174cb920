from codequarry.operators import intel


def test_texts_are_not_shuffled_by_word(spark):
    g = spark.createDataFrame([("factura", ["invoice"], ["billing"]), ("cierre de mes", ["month end"], ["accounting"])], "term string, english array<string>, tags array<string>")
    t = spark.createDataFrame([(1, "Las facturas del cierre de mes"), (2, "cierre del mes, prefactura"), (3, None)], "doc_id long, text string")
    hits = intel.glossary_terms(t, "doc_id", "text", g)
    assert sorted((r["doc_id"], r["term"]) for r in hits.collect()) == [(1, "cierre de mes"), (1, "factura")]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
