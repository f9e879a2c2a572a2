"""Details of one or all items and components, pages with totals, and orders that reports need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.rules import first_of
from evidentia.operators.listing import page


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with this key: none if there is no such row. The condition reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def item_details(items: DataFrame, links: DataFrame, components: DataFrame, assertions: DataFrame) -> DataFrame:
    """A row for each link of each item, with the component's names and whether any evidence is about it; items without links have one row of nulls."""
    known = assertions.select("ingredient_id").distinct().withColumn("has_evidence", F.lit(True))
    rows = items.select("product_id", "name").join(links.select("product_id", "ingredient_id", "position", "is_trace"), "product_id", "left")
    named = rows.join(components.select("ingredient_id", "inci_name", "cn_name"), "ingredient_id", "left").join(known, "ingredient_id", "left")
    return named.withColumn("has_evidence", F.when(F.col("ingredient_id").isNotNull(), F.coalesce("has_evidence", F.lit(False))))


def component_details(components: DataFrame, links: DataFrame, assertions: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """Each component with its caps, its number of assertions and of items, and one page of those items by id.

    Items are counted after equal links are made one. A page is taken by place, so no component's items are gathered as a whole.
    """
    own = links.select("ingredient_id", "product_id").distinct()
    totals = own.groupBy("ingredient_id").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("ingredient_id").orderBy("product_id"))
    paged = own.withColumn("place", place).where(F.col("place") <= offset + limit).where(F.col("place") > offset)
    shown = paged.groupBy("ingredient_id").agg(F.array_join(F.sort_array(F.collect_list("product_id")), ",").alias("items"))
    counted = assertions.groupBy("ingredient_id").agg(F.count("*").alias("assertion_count"))
    rows = components.select("ingredient_id", "inci_name", "legal_cap", "max_leave_on", "max_rinse_off")
    for other in (totals, counted, shown):
        rows = rows.join(other, "ingredient_id", "left")
    return rows.fillna({"total": 0, "assertion_count": 0, "items": ""})


def page_with_total(rows: DataFrame, order: list[Column], limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of the rows, each with the number of all of them."""
    total = rows.select(F.count("*").alias("total"))
    return page(rows, order, limit, offset).withColumn("total", total.scalar())


def in_order_of(column: str, values: list) -> Column:
    """An order key: the place of the value in the list, other values last."""
    places = F.create_map(*[F.lit(x) for k, value in enumerate(values) for x in (value, k)])
    return F.coalesce(F.element_at(places, F.col(column)), F.lit(len(values)))


def natural_order(column: str) -> list[Column]:
    """Shorter names first, then by name: file2 before file10."""
    return [F.length(column), F.col(column)]


def share_of_greatest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """`rows` with each value's share of the greatest of its key, in percent; null where none is above 0."""
    greatest = F.max(value).over(Window.partitionBy(key))
    return rows.withColumn("share", F.when(greatest > 0, F.round(100 * F.col(value) / greatest, 2)))


def most_frequent(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The `limit` most frequent values, ties by the smaller value."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(limit)


def unmapped_by_coverage(links: DataFrame, components: DataFrame, limit: int = 30) -> DataFrame:
    """Components without a Chinese name, most items first, ties by the greater name."""
    missing = components.where(F.coalesce(F.col("cn_name"), F.lit("")) == "").select("ingredient_id", "inci_name")
    counted = links.groupBy("ingredient_id").agg(F.count_distinct("product_id").alias("items"))
    return missing.join(counted, "ingredient_id").orderBy(F.desc("items"), F.desc("inci_name")).limit(limit)


def ordered_union(lists: list[DataFrame], key: str) -> DataFrame:
    """The rows of all lists one after another, each key only where it comes first; every list has key and place."""
    parts = [rows.select(key, F.col("place"), F.lit(k).alias("list")) for k, rows in enumerate(lists)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    first = every.groupBy(key).agg(F.min(F.struct("list", "place")).alias("first"))
    return first.select(key, "first.list", "first.place")


def typical_doses(formulas: DataFrame) -> DataFrame:
    """For each component the least and greatest percentage of its formulas, and how many different ones give it; formulas: ingredient_id, formulation, pct (low, high)."""
    given = formulas.where("pct is not null")
    return given.groupBy("ingredient_id").agg(F.min("pct.low").alias("typical_low"), F.max("pct.high").alias("typical_high"), F.count_distinct("formulation").alias("formulations"))


def following_lines(lines: DataFrame, key: str, place: str, text: str, starts: Column, confirms: Column, within: int = 6) -> DataFrame:
    """Lines that start something and are confirmed by one of the next `within` lines: how far that one is, and the text between.

    lines: key, place, text; starts and confirms are conditions over `text`.
    """
    own = Window.partitionBy(key).orderBy(place)
    ahead = F.array(*[F.lead(F.struct(F.col(text).alias("text"), confirms.alias("ok")), k).over(own) for k in range(1, within + 1)])
    marked = lines.withColumns({"_starts": starts, "_ahead": ahead}).where("_starts")
    distance = F.array_position(F.transform("_ahead", lambda x: F.coalesce(x["ok"], F.lit(False))), True)
    found = marked.withColumn("distance", distance).where("distance > 0")
    between = F.array_join(F.transform(F.slice("_ahead", 1, F.col("distance") - 1), lambda x: x["text"]), " ")
    return found.select(key, place, "distance", between.alias("between"))


def contained_names(names: DataFrame, others: DataFrame, shortest: int = 2) -> DataFrame:
    """Pairs (name, other) in which the name stands in the other, both of different values; by equality with the other's parts, so nothing is compared with everything.

    names: name; others: other. Names shorter than `shortest` are in too much to tell anything.
    """
    asked = names.select("name").distinct().where(F.length("name") >= shortest)
    lengths = sorted(r[0] for r in asked.select(F.length("name")).distinct().collect())  # one number for each length
    distinct = others.select("other").distinct()
    # only parts as long as some name are taken
    places = lambda n: F.transform(F.sequence(F.lit(1), F.length("other") - n + 1), lambda at: F.substring("other", at, n))
    parts = F.flatten(F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("other")), places))
    held = distinct.select("other", F.explode(F.array_distinct(parts)).alias("name"))
    return asked.join(held, "name").where(F.col("name") != F.col("other")).select("name", "other")


def mutual_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left, right) of names that are equal or of which one stands in the other; left: name, right: name."""
    a, b = (rows.select(F.btrim("name").alias("name")).where("name <> ''").distinct() for rows in (left, right))
    equal = a.select(F.col("name").alias("left")).join(b.select(F.col("name").alias("right")), F.col("left") == F.col("right"))
    inside = contained_names(a, b.withColumnRenamed("name", "other")).select(F.col("name").alias("left"), F.col("other").alias("right"))
    around = contained_names(b, a.withColumnRenamed("name", "other")).select(F.col("other").alias("left"), F.col("name").alias("right"))
    return equal.unionByName(inside).unionByName(around)


def repair(stored: DataFrame, backup: DataFrame, stored_key: Column, backup_key: Column, fields: list[str], order: list[Column]) -> DataFrame:
    """`stored` with nulls filled from the backup row of the same derived key (the first in `order`), and whether anything was filled."""
    best = backup.withColumn("_key", backup_key).where("_key is not null")
    best = best.withColumn("_place", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_place = 1")
    joined = stored.withColumn("_key", stored_key).join(best.select("_key", F.struct(*fields).alias("_old")), "_key", "left")
    filled = F.lit(False)
    for name in fields:
        filled = filled | (F.col(name).isNull() & F.col("_old")[name].isNotNull())
    repaired = joined.withColumn("repaired", filled)
    return repaired.select(*[F.coalesce(F.col(c), F.col("_old")[c]).alias(c) if c in fields else F.col(c) for c in stored.columns], "repaired")


def unique_hits(queries: DataFrame, register: DataFrame, key: str, value: str) -> DataFrame:
    """Each query's hits, and the value where there is just one: none and several both give null."""
    counted = register.groupBy(key).agg(F.count_distinct(value).alias("hits"), F.min(value).alias("_only"))
    joined = queries.join(counted, key, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return joined.withColumn(value, F.when(F.col("hits") == 1, F.col("_only"))).drop("_only")


def override(rows: DataFrame, overrides: DataFrame, key: str, field: str) -> DataFrame:
    """`rows` after a review: action "set" gives the field a new value, "withdraw" takes the row away, anything else keeps it; overrides: key, action, value."""
    joined = rows.join(overrides.select(key, "action", "value"), key, "left").where(~F.col("action").eqNullSafe("withdraw"))
    value = first_of([(F.col("action") == "set", F.col("value")), (F.lit(True), F.col(field))])
    return joined.withColumn(field, value).select(*rows.columns, F.coalesce("action", F.lit("keep")).alias("action"))


def parents_with_children(parents: DataFrame, children: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents that still have a child, and those that have lost all."""
    own = children.select(key).distinct()
    return parents.join(own, key, "left_semi"), parents.join(own, key, "left_anti")
