from lodestrata.operators import retrieval


def test_index_is_built_once_and_finds_what_is_asked(spark, tmp_path):
    df = spark.createDataFrame([(0, "nausea", 5), (1, "headache", 3), (2, "hair loss", 1)], "ord int, effect string, rating int")
    made = retrieval.index(spark, str(tmp_path), "my table/1", "cell", df, "ord")
    asked = spark.createDataFrame([(1, "head ache"), (2, "nausea?")], "id long, text string")
    best = {r.query_id: r.page_content for r in retrieval.hits(made, asked, 1).collect()}
    assert "headache" in best[1] and "nausea" in best[2]
    again = retrieval.index(spark, str(tmp_path), "my table/1", "cell", df.limit(0), "ord")
    assert again.count() == made.count() == 4
    assert {r.page_content for r in retrieval.corpus("schema", df.drop("ord"), "ord").collect()} == {"effect", "rating"}
    assert retrieval.corpus("row", df, "ord").count() == 3 and retrieval.corpus("column", df, "ord").count() == 2
    assert retrieval.corpus("other", df, "ord").count() == 0
