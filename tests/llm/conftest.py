import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    """Small documents with awkward rows: nulls, empty and long texts, repeats, an extra column with a clashing name."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000").select("doc_id", "text").collect()][:120]
    rows += [(9001, None), (9002, ""), (9003, "  \n "), (None, "a text whose id is missing, with ten words in all"), (9004, "x " * 30000), (9005, rows[0][1]), rows[1], (9006, "a" * 200), (9007, "Zażółć gęślą jaźń ΣΑΣ 日本語 😀 don't")]
    return spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_words int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_words int")
