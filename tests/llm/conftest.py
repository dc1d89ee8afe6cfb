import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, shard string, score string"


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """A folder of tables: nulls in any column, empty and long texts, repeated rows, clashing columns."""
    d = str(tmp_path_factory.mktemp("odd"))
    long = "The quick brown fox, isn't it? " * 4000
    texts = [None, "", " ", "\n\t ", "a", "Hello <|endoftext|> world  x", "é" * 3000 + " café \U0001f600‍", long, long, "word word  two　three", "x" * 70000, "don't  stop\r\n\r\nnow   ", long + "tail", "Σας ΟΔΟΣ é İ", "mit license apache license"]
    rows = [(i if i != 4 else None, t, None if i == 3 else "en", None if i in (2, 5) else f"s{i % 3}", None, "n", "s", "x") for i, t in enumerate(texts)]
    rows += rows[5:9] + [(None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture(scope="session")
def empty_docs(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def by_id(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, str(r)))
