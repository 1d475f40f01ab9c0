import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def odd_docs(spark: SparkSession):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, "the cat sat on the mat", "en", "a"), (2, "the  cat\tsat on the mat", "en", None), (3, None, None, "a"), (4, "", "de", "b"), (None, "the cat sat on the mat", None, None),
        (5, "Der Hund und die Katze, sie laufen durch den Wald.", "de", "b"), (5, "Der Hund und die Katze, sie laufen durch den Wald.", "de", "b"), (6, "el perro y la casa de los " * 4000, "es", "c"),
        (7, "123 456 --- !!!", "en", "c"), (8, "a b c a b c\nx\n\nx\n a b c", "fr", "a"), (9, "<|endoftext|> café 日本  x", "fr", "d"),
    ]
    extra = [r + (i, "s", 1.0, "k", 0, "m") for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, id long, _salt string, score double, key string, kept int, t string").repartition(3)


@pytest.fixture(scope="session")
def tables(spark, odd_docs, tmp_path_factory):
    """A folder with odd documents and pages, and one with empty tables."""
    full, empty = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("empty")
    body = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/x", "same"), (2, "http://b/y z", "same"), (3, None, None), (4, "u", ""), (None, "z", body), (2, "http://b/y z", "same"), (9, "http://ü b/", "x" * 300_000), (10, "", body)]
    pages = spark.createDataFrame([r + ("clash",) for r in rows], "page_id long, url string, html string, digest string")
    for name, df in (("documents", odd_docs), ("pages", pages)):
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    vectors = [(i % 40 if i % 7 else None, [float((i * j) % 13) / 4 for j in range(64)], "clash") for i in range(60)]
    vectors += [(1, None, "x"), (2, [], "x"), (3, [1.0] * 63, "x"), (4, [None, *[1.0] * 63], "x"), (5, [float("nan")] * 64, "x"), (6, [float("-inf"), *[1.0] * 63], "x")]
    embeddings = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, cluster string")
    embeddings.write.parquet(f"{full}/embeddings.parquet")
    embeddings.limit(0).write.parquet(f"{empty}/embeddings.parquet")
    return str(full), str(empty)
