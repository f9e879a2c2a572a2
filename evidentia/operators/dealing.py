"""How many tasks a table is dealt out to: so many that what one of them sorts or groups doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one task, about; what it holds of them in sorts and groups is some hundred bytes a row.
ROWS_A_TASK = 1 << 19


def parts_of(rows: DataFrame) -> int:
    """Partitions of about ROWS_A_TASK rows that `rows` fill; 0 where the session's own number is enough. `rows` are counted: give a table as it is read."""
    spark = rows.sparkSession
    n = -(-rows.count() // ROWS_A_TASK)
    own = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return n if n > own else 0


def dealt(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """`rows` by the hash of `keys` in `parts` partitions; as they are for 0, for then Spark deals them out well enough."""
    return rows.repartition(parts, *keys) if parts else rows
