import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def folder(spark, tmp_path):
    """Write texts (and other tables) as a folder of tables; returns its path."""

    def write(texts, sources=None, **tables):
        rows = [(i, t, "en", (sources or {}).get(i, f"src{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


EDGE_TEXTS = [
    None, "", " \n\t ", "one", "Ünï çödé 日本語 🙂 don't  stop\n\nnow\x1cthen\x85end 12345",
    "word " * 3000, "x" * 5000, "the same text twice, the same text twice", "the same text twice, the same text twice",
]
