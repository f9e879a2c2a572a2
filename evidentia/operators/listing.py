"""Lists, searches, counts and pages over items and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import fold

SORTS = ("claim_count", "ingredient_count")


def with_counts(rows: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """`rows` with the number of each child table's rows by `key`; children are counted before the join, so none multiplies another."""
    for name, child in children.items():
        rows = rows.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return rows


def contains_any(words: str, *columns: str) -> Column:
    """Whether some column has the words in it, in any case."""
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(name)), F.lower(F.lit(words))), F.lit(False))
    return found


def folded_search(words: str, *columns: str) -> Column:
    """Like contains_any, but blind to white space and hyphens."""
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.contains(fold(F.col(name)), fold(F.lit(words))), F.lit(False))
    return found


def flag_filter(rows: DataFrame, count: str, flag: str | None) -> DataFrame:
    """"true": the count is above 0; "false": it is 0; anything else doesn't filter."""
    if flag == "true":
        return rows.where(F.col(count) > 0)
    return rows.where(F.col(count) == 0) if flag == "false" else rows


def page(rows: DataFrame, order: list[Column], limit: int = 0, offset: int = 0) -> DataFrame:
    """Rows from `offset` on, at most `limit` of them (0: all), in an order that must be total."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    ordered = rows.orderBy(*order).offset(offset)
    return ordered.limit(limit) if limit else ordered


def list_components(components: DataFrame, assertions: DataFrame, words: str = "", has_evidence: str | None = None) -> DataFrame:
    counted = with_counts(components, "ingredient_id", assertion_count=assertions)
    if words:
        counted = counted.where(folded_search(words, "inci_name", "cn_name"))
    return flag_filter(counted, "assertion_count", has_evidence)


def list_items(items: DataFrame, links: DataFrame, claims: DataFrame, words: str = "", brand: str | None = None, has_claims: str | None = None, claim_words: list[str] | None = None) -> DataFrame:
    """Items with their numbers of claims and components."""
    if words:
        items = items.where(contains_any(words, "name", "brand"))
    if brand is not None:
        items = items.where(F.col("brand") == brand)
    if claim_words is not None:
        if not claim_words:
            raise ValueError("no words to look for in claims")
        claimed = claims.where(contains_any_of(claim_words, "claim"))
        items = items.join(claimed.select("product_id"), "product_id", "left_semi")
    return flag_filter(with_counts(items, "product_id", claim_count=claims, ingredient_count=links), "claim_count", has_claims)


def contains_any_of(words: list[str], column: str) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(F.col(column), F.lit(word))
    return found


def sort_order(sort: str | None) -> list[Column]:
    """The order of item lists: by brand, or by a count, most first; ties by id."""
    if sort is None:
        return [F.asc_nulls_last("brand"), F.asc("product_id")]
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    return [F.desc(sort), F.asc("product_id")]


def brands(items: DataFrame) -> DataFrame:
    return items.select("brand").where((F.col("brand") != "")).distinct().orderBy("brand")


def latest_and_history(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All rows with their age rank within the key (1 is the latest) and whether they are the latest."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(x).desc() for x in order]))
    return rows.withColumn("age_rank", rank).withColumn("is_latest", F.col("age_rank") == 1)


def penetration(links: DataFrame) -> DataFrame:
    """For each component: items that have it, its share of all items that have components, and its mean position."""
    total = links.select(F.count_distinct("product_id").alias("total"))
    by_component = links.groupBy("ingredient_id").agg(F.count_distinct("product_id").alias("products"), F.round(F.avg("position"), 1).alias("avg_position"))
    share = F.try_divide(F.col("products"), total.scalar())
    return by_component.withColumn("penetration", F.coalesce(F.round(share, 4), F.lit(0.0)))


def item_diff(links: DataFrame, a: str, b: str, pairs: DataFrame) -> DataFrame:
    """For each pair of items: components only in the first, only in the second, and in both."""
    own = links.select("product_id", "ingredient_id").distinct()
    keyed = pairs.withColumn("pair", F.struct(a, b))
    left = keyed.join(own, F.col(a) == own["product_id"]).select(a, b, "ingredient_id", F.lit(True).alias("in_a"))
    right = keyed.join(own, F.col(b) == own["product_id"]).select(a, b, "ingredient_id", F.lit(True).alias("in_b"))
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "only_a").otherwise("only_b")
    return left.join(right, [a, b, "ingredient_id"], "full").select(a, b, "ingredient_id", side.alias("side"))
