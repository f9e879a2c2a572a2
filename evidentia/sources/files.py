"""Files as tables: nested JSON documents, JSON lines, CSV with a byte order mark, pages, scanned lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources import schemas


def json_documents(spark: SparkSession, path: str, schema: str, recursive: bool = False) -> DataFrame:
    """One row for each file (a whole JSON document), with its path."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", recursive)
    return reader.json(path).select("*", F.col("_metadata.file_path").alias("file_path"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; quoted fields may hold line ends, and a byte order mark is passed over."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path)


def evidence_batch(spark: SparkSession, path: str) -> DataFrame:
    """A row for each assertion of a batch file; components without assertions have one row of nulls."""
    documents = json_documents(spark, path, schemas.EVIDENCE_BATCH)
    components = documents.select("file_path", F.inline_outer("ingredients"))
    rows = components.select("file_path", "inci_name", "cn_name", "cas_no", F.explode_outer("assertions").alias("a"))
    return rows.select("file_path", "inci_name", "cn_name", "cas_no", F.col("a.efficacy").alias("effect"), F.col("a.effective_conc_low").alias("effective_low"), F.col("a.effective_conc_high").alias("effective_high"), F.col("a.note").alias("note"), "a.evidence.*")


def ocr_boxes(spark: SparkSession, path: str, pdf_contains: str = "") -> DataFrame:
    """A row for each scanned line, with the corners of its box."""
    pages = json_lines(spark, path, schemas.OCR_LINES).where(F.col("pdf").contains(pdf_contains))
    rows = pages.select("pdf", "page", "width", F.inline("lines"))
    xs, ys = F.transform("box", lambda p: p[0]), F.transform("box", lambda p: p[1])
    return rows.select("pdf", "page", "width", F.array_min(xs).alias("left"), F.array_max(xs).alias("right"), F.array_min(ys).alias("top"), F.array_max(ys).alias("bottom"), "text", "score")


def benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    """Products of a benchmark file with their skin types as an array of flags."""
    rows = csv_table(spark, path, schemas.BENCHMARK_CSV)
    return rows.withColumn("skin", F.array("Combination", "Dry", "Normal", "Oily", "Sensitive"))


def check_complete(rows: DataFrame, key: str, expected: int) -> None:
    """Raise if the parts that were read don't hold as many different keys as expected."""
    found = rows.agg(F.count_distinct(key)).first()[0]
    if found != expected:
        raise ValueError(f"{found} different {key}, expected {expected}")


def json_documents_in_order(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of a folder and those below it, each with its stem and its place: shorter stems first, then by name."""
    from pyspark.sql.window import Window

    rows = json_documents(spark, path, schema, recursive=True)
    stem = F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    named = rows.select("file_path", stem.alias("stem")).distinct()
    # one row a file: a folder's listing, which the driver holds anyway
    places = named.withColumn("place", F.row_number().over(Window.orderBy(F.length("stem"), "stem", "file_path")))
    return rows.join(places, "file_path")


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines, in place of an earlier one."""
    rows.write.mode("overwrite").json(path)


def write_index(rows: DataFrame, path: str) -> None:
    """A vector index (id, embedding, ...), rebuilt as a whole."""
    rows.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index at `path`, or None where there is none yet; other failures are raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def with_neighbours(spark: SparkSession, path: str, query_id: int, k: int = 10) -> tuple[str, DataFrame | None]:
    """The state of a search and its rows: "unavailable" without an index, "ok" with one, where an unknown id finds nothing."""
    from evidentia.operators import vectors

    index = read_index(spark, path)
    if index is None:
        return "unavailable", None
    rows = index.select("id", F.col("embedding").alias("vector"))
    return "ok", vectors.nearest(rows, rows.where(F.col("id") == query_id), k)


class Snapshots:
    """Tables held in the cluster's memory by path, read anew when their files change (names, sizes or times)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: dict[str, tuple[str, DataFrame]] = {}

    def signature(self, path: str) -> str:
        files = self.spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
        return str(files.agg(F.count("*"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first())

    def table(self, path: str) -> DataFrame:
        signature = self.signature(path)
        known = self.held.get(path)
        if known and known[0] == signature:
            return known[1]
        if known:
            known[1].unpersist()
        self.spark.catalog.refreshByPath(path)
        self.held[path] = (signature, self.spark.read.parquet(path).persist())
        return self.held[path][1]
