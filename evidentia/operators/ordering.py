"""Numbers in an order over whole tables, without a window that gathers all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.storage import materialize


def numbered(df: DataFrame, order: list[Column], name: str = "n", start: int = 1) -> DataFrame:
    """`df` with gapless numbers from `start` in `order`, as a long column `name`.

    Rows are range-partitioned, sorted in each partition and written; the partitions' sizes (one number a partition) give
    each its offset. Rows that are equal in `order` get different numbers in any order; give a last key that tells rows apart
    where many may be equal, for rows of one key stay in one partition. An empty table gives an empty one.
    """
    at, part = f"{name}__at", f"{name}__part"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = materialize(placed, "numbered").withColumn(part, F.shiftright(at, 33))
    offsets, before = [], start
    for row in placed.groupBy(part).agg((F.max(at) - F.shiftleft(F.max(part), 33) + 1).alias("rows")).orderBy(part).collect():
        offsets.append((row[part], before))
        before += row["rows"]
    found = df.sparkSession.createDataFrame(offsets, f"{part} long, {name}__offset long")
    return (
        placed.join(F.broadcast(found), part)
        .withColumn(name, F.col(f"{name}__offset") + F.col(at) - F.shiftleft(part, 33))
        .select(*[F.col(f"`{x}`") for x in df.columns], name)
    )
