"""Changes of stored tables as joins: insert if absent, upsert, null-only backfill, sync of stale rows, ledgers, splits.

Each returns the new table (or the changed part), never writes in place, and does nothing when applied again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def null_safe(left: str, right: str, keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in an order that must be total."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`stored` and those of `new` whose natural keys it lacks, one row each."""
    fresh = first_of_each(new, keys, order).alias("n").join(stored.select(*keys).alias("s"), null_safe("n", "s", keys), "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`stored` with rows of equal keys replaced by the first of `new`, and the other new rows added."""
    fresh = first_of_each(new, keys, order)
    kept = stored.alias("s").join(fresh.select(*keys).alias("n"), null_safe("s", "n", keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def backfill(stored: DataFrame, new: DataFrame, keys: list[str], field: str, correct: bool = False, clear_none: bool = False) -> DataFrame:
    """`stored` with nulls of `field` filled from `new` (one row a key), and what was done: set, conflict, corrected, cleared or none.

    correct: values of `new` win over others; clear_none: a null of `new` takes away what is stored.
    """
    joined = stored.alias("s").join(new.select(*keys, F.struct(F.col(field).alias("value")).alias("_new")).alias("n"), keys, "left")
    old, fresh = F.col(field), F.col("_new.value")
    differs = old.isNotNull() & fresh.isNotNull() & (old != fresh)
    cleared = F.col("_new").isNotNull() & fresh.isNull() & old.isNotNull() & F.lit(clear_none)
    action = F.when(cleared, "cleared").when(old.isNull() & fresh.isNotNull(), "set").when(differs, "corrected" if correct else "conflict").otherwise("none")
    value = F.when(~cleared, F.coalesce(fresh, old) if correct else F.coalesce(old, fresh))
    return joined.withColumns({"action": action, "_value": value}).withColumn(field, F.col("_value")).select(*stored.columns, "action")


def sync(stored: DataFrame, fresh: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """`stored` with the fields of `fresh` where they differ, and whether a row was dirty."""
    other = fresh.select(*keys, F.struct(*fields).alias("_new"))
    joined = stored.join(other, keys, "left")
    dirty = F.lit(False)
    for name in fields:
        dirty = dirty | ~F.col(name).eqNullSafe(F.col("_new")[name])
    dirty = F.col("_new").isNotNull() & dirty
    synced = joined.withColumn("dirty", dirty)
    return synced.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns], "dirty")


def not_done(rows: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the ledger lacks: what a resumed run still has to do."""
    return rows.alias("n").join(ledger.select(*keys).alias("s"), null_safe("n", "s", keys), "left_anti")


def split_rows(rows: DataFrame, passes: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and all others (where the condition is null, too)."""
    held = F.coalesce(passes, F.lit(False))
    return rows.where(held), rows.where(~held)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with a key that no parent has."""
    return children.where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")


def action_counts(rows: DataFrame, action: str = "action") -> DataFrame:
    return rows.groupBy(action).agg(F.count("*").alias("n"))
