"""Resolving names: several keys with narrowing, tiers down to parts of names, verdicts of pairs, targets in titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.text import in_parentheses, name_key, no_empty, without_parentheses
from evidentia.operators.details import contained_names


def product_keys(name: Column, prefix: str = "") -> Column:
    """The keys that a product's name is known by: the name without what stands in parentheses, and each of those parts; a brand in front (a pattern) is passed over."""
    bare = lambda text: name_key(F.regexp_replace(F.btrim(text), f"(?i)^(?:{prefix})\\s*", "") if prefix else text)
    return F.array_distinct(no_empty(F.concat(F.array(bare(without_parentheses(name))), F.transform(in_parentheses(name), bare))))


def narrowed(candidates: DataFrame, key: str, steps: list[Column]) -> DataFrame:
    """Of each key's candidates those that the steps leave: a step drops the others where some candidate meets it, and nobody where none does."""
    own = Window.partitionBy(key)
    for step in steps:
        met = F.coalesce(step, F.lit(False))
        candidates = candidates.withColumns({"_met": met, "_any": F.max(met).over(own)}).where(F.col("_met") | ~F.col("_any")).drop("_met", "_any")
    return candidates


def match_by_keys(pages: DataFrame, items: DataFrame, steps: list[Column], prefix: str = "") -> DataFrame:
    """page_id, candidates and product_id: the one item that shares a key with the page after narrowing; null where none or several are left.

    pages: page_id and keys (array); items: product_id, name and what the steps ask for.
    """
    keyed = items.withColumn("key", F.explode(product_keys(F.col("name"), prefix)))
    wanted = pages.select("page_id", F.explode("keys").alias("key"))
    found = wanted.join(keyed, "key").drop("key").dropDuplicates(["page_id", "product_id"])
    counted = found.groupBy("page_id").agg(F.count("*").alias("candidates"))
    left = narrowed(found, "page_id", steps).groupBy("page_id").agg(F.min("product_id").alias("product_id"), F.count("*").alias("n"))
    chosen = left.select("page_id", F.when(F.col("n") == 1, F.col("product_id")).alias("product_id"))
    return pages.select("page_id").join(counted, "page_id", "left").join(chosen, "page_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def resolve(queries: DataFrame, register: DataFrame, aliases: DataFrame, shortest: int = 2) -> DataFrame:
    """query, ingredient_id and via of every query: by alias, equal name, beginning or part of a name, in this order; then shorter names and smaller ids win.

    queries: query; register: ingredient_id, name; aliases: alias, ingredient_id. Upper and lower case are one.
    """
    asked = queries.select(F.upper(F.btrim("query")).alias("key")).where("key <> ''").distinct()
    named = register.select("ingredient_id", F.upper("name").alias("name"))
    hit = lambda rows, tier, size: rows.select("key", F.lit(tier).alias("tier"), size.alias("size"), "ingredient_id")
    by_alias = asked.join(aliases.select(F.upper("alias").alias("key"), "ingredient_id"), "key")
    equal = asked.join(named.withColumnRenamed("name", "key"), "key")
    inside = contained_names(asked.select(F.col("key").alias("name")), named.select(F.col("name").alias("other")), shortest)
    inside = inside.select(F.col("name").alias("key"), F.col("other").alias("name")).join(named, "name")
    hits = hit(by_alias, 0, F.lit(0)).unionByName(hit(equal, 1, F.lit(0)))
    tier = F.when(F.startswith("name", "key"), 2).otherwise(3)
    hits = hits.unionByName(inside.select("key", tier.alias("tier"), F.length("name").alias("size"), "ingredient_id"))
    best = hits.groupBy("key").agg(F.min(F.struct("tier", "size", "ingredient_id")).alias("best"))
    via = F.get(F.array(*map(F.lit, ("alias", "exact", "prefix", "part"))), F.col("best.tier"))
    joined = queries.select("query").withColumn("key", F.upper(F.btrim("query"))).join(best, "key", "left")
    return joined.select("query", F.col("best.ingredient_id").alias("ingredient_id"), via.alias("via"))


def verdict_agreement(verdicts: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b and, of the components that both have a verdict on, how many there are and on how many their sets of verdicts are equal.

    verdicts: product_id, ingredient_id, verdict; pairs: a, b.
    """
    sets = verdicts.where("verdict is not null").groupBy("product_id", "ingredient_id").agg(F.array_sort(F.collect_set("verdict")).alias("verdicts"))
    side = lambda name: sets.select(F.col("product_id").alias(name), "ingredient_id", F.col("verdicts").alias(f"of_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "ingredient_id"])
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum((F.col("of_a") == F.col("of_b")).cast("long")).alias("equal"))


def targets_in_titles(titles: DataFrame, title: Column, targets: dict[str, list[str]]) -> DataFrame:
    """A row for each target that a title has a keyword of; the targets are a short list, given with the call."""
    lowered = F.lower(title)
    named = [F.when(F.array_contains(F.array(*[F.contains(lowered, F.lit(word.lower())) for word in words]), True), F.lit(name)) for name, words in targets.items()]
    return titles.withColumn("target", F.explode(F.array_compact(F.array(*named))))
