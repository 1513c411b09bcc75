from strandlake.llm.queries import ORACLE_SQL, QUERIES


def test_every_operator_has_a_query(spark, small):
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
    for name, key in (("op1_packing", None), ("op5_chat", "conv_id"), ("op7_html", "page_id"), ("op9_language", "doc_id"), ("op10_quality", "doc_id")):
        rows = QUERIES[name](spark, small)
        n = rows.count()
        assert n and (key is None or rows.select(key).distinct().count() == n)
