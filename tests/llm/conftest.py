import pytest
from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"
LONG = "uno dos tres cuatro " * 3000 + "x" * 30_000 + " fin"
#: Nulls, empty and long texts, ties, repeated rows, odd white space, letters beyond the basic plane.
ODD = [
    (1_000_001, None, "en", "web"),
    (1_000_002, "", "en", None),
    (1_000_003, " \t\r\n\x0b\x0c ", None, "web"),
    (1_000_004, LONG, "en", "web"),
    (1_000_005, "Same  words here", "en", "web"),
    (1_000_006, "Same words here", "en", "web"),
    (1_000_006, "Same words here", "en", "web"),
    (None, "Same words\nhere", "en", "web"),
    (None, None, None, None),
    (1_000_007, " naïve  café \U0001f600\U0001f600 你好 123 it's we'll \x00 end", "fr", "web"),
    (1_000_008, "one", "en", "web"),
    (1_000_009, "<|endoftext|> <|startoftext|>a<|endoftext|>", "en", "web"),
    (1_000_010, "A b C d E f " * 40, "en", "web"),
    (1_000_011, "line one two\nline one two\n\n \nline one two\nother", "en", "web"),
    (1_000_012, "tab\tand　wide sep  double   triple    spaces\n\n\nbreaks \n mixed", "es", "web"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The smallest documents table, odd rows, and columns whose names clash with those of the operators."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(x, T.StringType()) for x in ("text", "lang", "source")]])
    odd = spark.createDataFrame(ODD, schema)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(odd)
    for name in ("own", "words", "rid", "score", "kept", "piece", "fp", "n_words", "base_failed", "component_id", "_toxicity"):
        docs = docs.selectExpr("*", f"cast(null as string) as {name}")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/edge-docs"
    docs.repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def edge_rows(edge_docs):
    """The same rows on the driver."""
    return [(r["doc_id"], r["text"] or "", r["lang"], r["source"]) for r in edge_docs.collect()]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")
