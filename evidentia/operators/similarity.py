"""Similarity of items: shared components, doses, effect profiles, and the scorecard that weighs them.

Searches take a table of query items against all items. Sparse vectors stay in long form and meet by equality joins on
their dimension, so work is one shuffle by dimension and one by pair; skewed dimensions are split by the engine's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import dose, rules
from evidentia.operators.dealing import dealt, parts_of
from evidentia.storage import materialize

#: Weights of components, effects and price.
WEIGHTS = {"ingredient": 0.5, "efficacy": 0.3, "price": 0.2}
#: Families of one profile; beyond, they aren't families but free texts.
MOST_FAMILIES = 256


def top(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def distinct_components(links: DataFrame) -> DataFrame:
    """product_id and ingredient_id of each item's different components; large tables are dealt out by item, in more partitions the more links there are."""
    return dealt(links.select("product_id", "ingredient_id"), parts_of(links), "product_id").distinct()


def component_overlap(links: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, product_id, shared, union_size and jaccard of every other item that shares a component with a query item."""
    return _overlap(materialize(distinct_components(links), "components"), queries)


def _overlap(own: DataFrame, queries: DataFrame) -> DataFrame:
    """component_overlap of different components; sizes are put beside pairs, not beside each component."""
    sizes = own.groupBy("product_id").agg(F.count("*").alias("size"))
    asked = own.join(queries.select("product_id"), "product_id", "left_semi").select(F.col("product_id").alias("query_id"), "ingredient_id")
    shared = _meet(asked, own, "ingredient_id").groupBy("query_id", "product_id").agg(F.count("*").alias("shared"))
    sized = shared.join(sizes, "product_id").join(sizes.select(F.col("product_id").alias("query_id"), F.col("size").alias("query_size")), "query_id")
    union = F.col("query_size") + F.col("size") - F.col("shared")
    return sized.select("query_id", "product_id", "shared", union.alias("union_size"), (F.col("shared") / union).alias("jaccard"))


def _meet(asked: DataFrame, rows: DataFrame, dimension: str) -> DataFrame:
    """Query rows beside those of other items, dimension by dimension: the few query rows are hashed, and the others stream past them unsorted."""
    return rows.join(asked.hint("shuffle_hash"), dimension).where(F.col("query_id") != F.col("product_id"))


#: A component is frequent if more than one item in so many has it; frequent components don't bring items together as long as the others decide.
FREQUENT_ONE_IN = 4


def _marked(own: DataFrame) -> DataFrame:
    """product_id, ingredient_id and frequent of different components. There are at most FREQUENT_ONE_IN times as many frequent ones as an item has components on average."""
    n_items = own.select(F.count_distinct("product_id").alias("n")).scalar()
    spread = own.groupBy("ingredient_id").agg(F.count("*").alias("spread"))
    frequent = spread.where(F.col("spread") * FREQUENT_ONE_IN > n_items).select("ingredient_id", F.lit(True).alias("frequent"))
    return own.join(F.broadcast(frequent), "ingredient_id", "left").select("product_id", "ingredient_id", F.coalesce("frequent", F.lit(False)).alias("frequent"))


def decided_by_rare(links: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The overlaps of query items with items that share one of their rarer components, and the queries that these decide.

    Frequent components are only read to complete the counts, from the lists of the two items. An item that shares none but frequent components has at most the
    share of those among the query's components as its similarity; where the k-th best found is above that, no such item is among the best.
    """
    return _decided(materialize(distinct_components(links), "components"), queries, k)


def _decided(own: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    marked = _marked(own)
    lists = marked.groupBy("product_id").agg(F.count("*").alias("size"), F.collect_list(F.when(F.col("frequent"), F.col("ingredient_id"))).alias("frequent"))
    # read beside the items of pairs, beside their queries, and by the bounds
    lists = materialize(lists, "lists")
    rare = marked.where(~F.col("frequent")).select("product_id", "ingredient_id")
    asked = rare.join(queries.select("product_id"), "product_id", "left_semi").select(F.col("product_id").alias("query_id"), "ingredient_id")
    met = _meet(asked, rare, "ingredient_id").groupBy("query_id", "product_id").agg(F.count("*").alias("rare_shared"))
    of_query = lists.select(F.col("product_id").alias("query_id"), F.col("size").alias("query_size"), F.col("frequent").alias("query_frequent"))
    of_query = of_query.join(queries.select(F.col("product_id").alias("query_id")), "query_id", "left_semi")
    both = met.join(lists, "product_id").join(of_query, "query_id")
    both = both.withColumn("shared", F.col("rare_shared") + F.size(F.array_intersect("query_frequent", "frequent")))
    union = F.col("query_size") + F.col("size") - F.col("shared")
    found = both.select("query_id", "product_id", "shared", union.alias("union_size"), (F.col("shared") / union).alias("jaccard"))
    bound = of_query.select("query_id", (F.size("query_frequent") / F.col("query_size")).alias("bound"))
    found = materialize(found, "overlaps")
    kth = top(found, "query_id", k, F.desc("jaccard"), F.asc("product_id")).where(F.col("rank") == k).select("query_id", "jaccard")
    decided = bound.join(kth, "query_id", "left").where((F.col("bound") == 0) | (F.col("jaccard") > F.col("bound"))).select(F.col("query_id").alias("product_id"))
    return found, decided


def similar_by_components(links: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k items of the largest Jaccard similarity; queries that their rarer components don't decide are compared with all items that share any component."""
    own = materialize(distinct_components(links), "components")
    found, decided = _decided(own, queries, k)
    decided = materialize(decided, "decided")
    overlaps = found.join(decided.select(F.col("product_id").alias("query_id")), "query_id", "left_semi")
    # queries without components have nothing to be compared
    left = materialize(queries.select("product_id").join(decided, "product_id", "left_anti").join(own, "product_id", "left_semi"), "undecided")
    if not left.isEmpty():
        overlaps = overlaps.unionByName(_overlap(own, left))
    best = top(overlaps, "query_id", k, F.desc("jaccard"), F.asc("product_id"))
    return best.select("query_id", "product_id", "rank", F.round("jaccard", 4).alias("score"), "shared")


def dose_vectors(links: DataFrame) -> DataFrame:
    """The middle of each component's interval; of repeated components the highest counts."""
    known = dealt(links.where("conc_low is not null and conc_high is not null"), parts_of(links), "product_id")
    return known.groupBy("product_id", "ingredient_id").agg(F.max((F.col("conc_low") + F.col("conc_high")) / 2).alias("weight"))


def paired(vectors: DataFrame, queries: DataFrame, value: Column, name: str) -> DataFrame:
    """query_id, product_id, query_norm, norm of items that share a dimension with a query, and the sum of `value` (over query_weight and weight) as `name`.

    The vectors are written once and read by norms, queries and items. Lengths are put beside pairs, not beside each component.
    """
    vectors = materialize(vectors, "vectors")
    norms = vectors.groupBy("product_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    asked = vectors.join(queries.select("product_id"), "product_id", "left_semi").select(F.col("product_id").alias("query_id"), "ingredient_id", F.col("weight").alias("query_weight"))
    pairs = _meet(asked, vectors, "ingredient_id").groupBy("query_id", "product_id").agg(F.sum(value).alias(name))
    return pairs.join(norms, "product_id").join(norms.select(F.col("product_id").alias("query_id"), F.col("norm").alias("query_norm")), "query_id")


def similar_by_dose(links: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Cosine of doses where each shared component counts by its lower dose."""
    both = F.least("query_weight", "weight")
    pairs = paired(dose_vectors(links), queries, both * both, "shared")
    scored = pairs.where("shared > 0").withColumn("score", F.round(dose.cosine_min(F.col("shared"), F.col("query_norm"), F.col("norm")), 4))
    best = top(scored, "query_id", k, F.desc("score"), F.asc("product_id"))
    return best.select("query_id", "product_id", "rank", "score")


def contributions(links: DataFrame, assertions: DataFrame) -> DataFrame:
    """Each link with each of its component's assertions: family, factor, contribution and why it is excluded, if it is."""
    family = rules.family_or_canonical(F.col("family"), F.col("effect"))
    interval = [F.col(x) for x in ("conc_low", "conc_high", "effective_low", "is_trace")]
    joined = links.join(assertions.withColumn("family", family), "ingredient_id")
    return joined.withColumns(
        {
            "factor": dose.dose_factor(*interval),
            "basis": dose.dose_basis(*interval),
            "contribution": dose.floor4(dose.dose_factor(*interval) * F.coalesce("strength", F.lit(0.0))),
            "excluded": dose.exclusion(F.col("level"), F.col("family"), F.col("kind")),
        }
    )


def fingerprints(links: DataFrame, assertions: DataFrame) -> DataFrame:
    """product_id, family and weight: the best contribution of each component to each family, summed over components."""
    counted = contributions(links, assertions).where("excluded is null and contribution > 0")
    best = counted.groupBy("product_id", "ingredient_id", "family").agg(F.max("contribution").alias("best"))
    return best.groupBy("product_id", "family").agg(F.round(F.sum("best"), 4).alias("weight"))


def link_fingerprints(links: DataFrame, assertions: DataFrame, link_key: str = "link_id") -> DataFrame:
    """Like fingerprints, but summed over links: a component that an item lists twice counts twice."""
    counted = contributions(links, assertions).where("excluded is null and contribution > 0")
    best = counted.groupBy("product_id", link_key, "family").agg(F.max("contribution").alias("best"))
    return best.groupBy("product_id", "family").agg(F.round(F.sum("best"), 4).alias("weight"))


def fingerprint_coverage(links: DataFrame, assertions: DataFrame) -> DataFrame:
    """For each item: links, links with assertions, with and without an estimate, and excluded assertions."""
    family = rules.family_or_canonical(F.col("family"), F.col("effect"))
    excluded = dose.exclusion(F.col("level"), family, F.col("kind")).isNotNull().cast("int")
    by_component = assertions.groupBy("ingredient_id").agg(F.sum(excluded).alias("excluded"))
    joined = links.join(by_component, "ingredient_id", "left")
    inferred = F.sum(F.col("conc_low").isNotNull().cast("int"))
    return joined.groupBy("product_id").agg(
        F.count("*").alias("ingredients_total"),
        F.sum(F.col("excluded").isNotNull().cast("int")).alias("ingredients_with_assertion"),
        inferred.alias("inferred_dose"),
        (F.count("*") - inferred).alias("unknown_dose"),
        F.coalesce(F.sum("excluded"), F.lit(0)).alias("excluded_count"),
    )


def _effect_maps(profiles: DataFrame) -> DataFrame:
    """product_id, weights (by family) and norm; a profile has as many entries as there are families, and OTHER doesn't count."""
    named = profiles.where(F.col("family") != rules.OTHER)
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    return named.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("family", "weight"))).alias("weights"), length.alias("norm"))


def effect_cosines(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """`pairs` (query_id, product_id) that share a family, with cosine, shared families and the three that both have most of."""
    maps = _effect_maps(profiles)
    asked = maps.select(F.col("product_id").alias("query_id"), F.col("weights").alias("query_weights"), F.col("norm").alias("query_norm"))
    both = pairs.join(asked, "query_id").join(maps, "product_id")
    shared = F.array_intersect(F.map_keys("query_weights"), F.map_keys("weights"))
    least = lambda x: F.least(F.col("query_weights")[x], F.col("weights")[x])
    both = both.withColumn("shared_families", F.sort_array(F.transform(shared, lambda x: F.struct((-least(x)).alias("order"), x.alias("family")))))
    dot = F.aggregate(shared, F.lit(0.0), lambda total, x: total + F.col("query_weights")[x] * F.col("weights")[x])
    return both.where(F.size("shared_families") > 0).select(
        *pairs.columns,
        (dot / (F.col("query_norm") * F.col("norm"))).alias("cosine"),
        F.size("shared_families").cast("long").alias("dimensions"),
        F.array_join(F.slice("shared_families", 1, 3)["family"], ",").alias("top_families"),
    )


def similar_by_effects(profiles: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k items of the largest cosines. Profiles have a dimension for each family, so they are searched as dense vectors: each task
    sends k rows a query, and never a row for every pair of items that share a family."""
    from evidentia.operators import vectors

    # read by the list of families, the dense vectors, the queries and the final cosines
    profiles = materialize(profiles, "profiles")
    families = sorted(r.family for r in profiles.where(F.col("family") != rules.OTHER).select("family").distinct().limit(MOST_FAMILIES + 1).collect())
    if len(families) > MOST_FAMILIES:
        raise ValueError(f"more than {MOST_FAMILIES} families: name them by rules.canonical_family first")
    of = lambda name: F.coalesce(F.col("weights")[name], F.lit(0.0)) / F.col("norm")
    dense = _effect_maps(profiles).where("norm > 0").select(F.col("product_id").alias("id"), F.array(*[of(x) for x in families or [rules.OTHER]]).alias("vector"))
    asked = dense.join(queries.select(F.col("product_id").alias("id")), "id", "left_semi")
    near = vectors.nearest(dense, asked, k, decimals=4).select("query_id", F.col("id").alias("product_id"), "rank", "score")
    return effect_cosines(near, profiles).select("query_id", "product_id", "rank", "score", "dimensions", "top_families")


def substitutes(items: DataFrame, links: DataFrame, profiles: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Weighted components, effects and price of other items; a part that can't be told is left out and the rest weighs more."""
    overlap = component_overlap(links, queries)
    named = profiles.where(F.col("family") != rules.OTHER).select("product_id").distinct().withColumn("has_profile", F.lit(True))
    as_query = lambda rows, value, name: rows.select(F.col("product_id").alias("query_id"), F.col(value).alias(name))
    joined = (
        overlap.join(effect_cosines(overlap.select("query_id", "product_id"), profiles).select("query_id", "product_id", "cosine"), ["query_id", "product_id"], "left")
        .join(named, "product_id", "left")
        .join(as_query(named, "has_profile", "query_profile"), "query_id", "left")
        .join(items.select("product_id", "price"), "product_id", "left")
        .join(as_query(items, "price", "query_price"), "query_id", "left")
    )
    cosine = F.when(F.col("has_profile") & F.col("query_profile"), F.coalesce("cosine", F.lit(0.0)))
    parts = {"ingredient": F.col("jaccard"), "efficacy": cosine, "price": dose.price_similarity(F.col("query_price"), F.col("price"))}
    total = sum((F.when(parts[x].isNotNull(), F.lit(w)).otherwise(0.0) for x, w in WEIGHTS.items()), F.lit(0.0))
    score = sum((F.coalesce(parts[x] * F.lit(w), F.lit(0.0)) for x, w in WEIGHTS.items()), F.lit(0.0)) / total
    scored = joined.select(
        "query_id",
        "product_id",
        "shared",
        F.round(score, 4).alias("score"),
        *[F.round(parts[x], 4).alias(f"{x}_score") for x in WEIGHTS],
        *[F.round(F.when(parts[x].isNotNull(), F.lit(w)).otherwise(0.0) / total, 4).alias(f"{x}_weight") for x, w in WEIGHTS.items()],
    )
    return top(scored, "query_id", k, F.desc("score"), F.asc("product_id"))
