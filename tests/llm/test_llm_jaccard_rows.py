from quarry.llm.jaccard_join import keep_one


def words(tag, n=60):
    return " ".join(f"{tag}{k}" for k in range(n))


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text) for r in keep_one(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_rows_without_id_go_each_with_its_own_class(spark):
    rows = [(1, words("a")), (None, words("a") + " x"), (None, words("b")), (None, words("c")), (None, words("c")),
            (None, None), (None, "")]
    assert kept(spark, rows) == [(1, words("a")), (None, ""), (None, None), (None, words("b")), (None, words("c"))] \
        or kept(spark, rows) == [(1, words("a")), (None, None), (None, ""), (None, words("b")), (None, words("c"))]


def test_rows_that_share_an_id_go_each_with_its_own_class(spark):
    rows = [(1, words("a")), (5, words("a")), (5, words("b")), (7, words("b")), (5, words("b")), (9, words("d"))]
    assert kept(spark, rows) == [(1, words("a")), (5, words("b")), (9, words("d"))]
