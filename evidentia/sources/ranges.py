"""Reading a register in ranges of its keys, each small enough for a source that gives only so many rows of one question, and telling whether all of it has come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.operators.ordering import numbered


def placed_keys(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The different keys with range_no: `most` neighbouring keys to a range, in the order of their type (strings by their characters). Null keys are in none.

    Keys are numbered by a range-partitioned sort, so no task holds more than its share.
    """
    different = rows.select(key).where(F.col(key).isNotNull()).distinct()
    return numbered(different, [F.asc(key)], "_n").select(key, F.floor((F.col("_n") - 1) / most).alias("range_no"))


def key_ranges(rows: DataFrame, key: str, most: int) -> DataFrame:
    """range_no, low, high and n: ranges low <= key < high (null: no upper end) of at most `most` different keys each."""
    ranges = placed_keys(rows, key, most).groupBy("range_no").agg(F.min(key).alias("low"), F.count("*").alias("n"))
    following = ranges.select((F.col("range_no") - 1).alias("range_no"), F.col("low").alias("high"))
    return ranges.join(following, "range_no", "left").select("range_no", "low", "high", "n")


def pages_of(rows: DataFrame, key: str, most: int, page_rows: int) -> DataFrame:
    """`rows` with range_no and page_no: within a range by key, page_rows rows a page, as a reader of one range after another gets them."""
    inside = rows.join(placed_keys(rows, key, most), key)
    place = F.row_number().over(Window.partitionBy("range_no").orderBy(key))
    return inside.withColumn("page_no", (F.floor((place - 1) / page_rows) + 1).cast("long")).select(*rows.columns, "range_no", "page_no")


def completeness(fetched: DataFrame, key: str, stated: DataFrame) -> DataFrame:
    """One row: stated (the greatest total that any page states), rows_fetched, unique_keys, and complete, whether there are as many different keys as stated.

    stated: total.
    """
    both = fetched.select(F.lit(1).alias("row"), F.col(key), F.lit(None).cast("long").alias("total")).unionByName(
        stated.select(F.lit(None).cast("int").alias("row"), F.lit(None).cast(fetched.schema[key].dataType).alias(key), F.col("total").cast("long").alias("total"))
    )
    counted = both.agg(F.max("total").alias("stated"), F.count("row").alias("rows_fetched"), F.count_distinct(key).alias("unique_keys"))
    return counted.select("stated", "rows_fetched", "unique_keys", (F.col("stated") == F.col("unique_keys")).alias("complete"))
