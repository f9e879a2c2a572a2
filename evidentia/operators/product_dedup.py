"""Items that stand twice in a table, in two languages or under one name written twice: links by kind, clusters, keepers, brands, merged links.

Formulas (sets of component keys) are classes first, and classes meet by their rarest keys. Across languages only the best item of a class and language can be linked, so
links are looked for between classes, and a link stays if each is the other's best. Within a language names decide: items of one class and one multiset of words are one node;
nodes meet by equal sets of words, or, for words that differ by up to two letters, in deletion neighbourhoods: both have the same other words and a word that becomes the same
when up to two letters are left out; where two formulas have few nodes, all are compared instead. Distinct names in one neighbourhood are bounded by the alphabet, not by the table, so no group gives all pairs of its items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.text import CJK, has_cjk, name_tokens, same_name
from evidentia.operators.components import components
from evidentia.operators.dedup import CONTAINMENT, JACCARD, MAX_SIZE_DIFF, RELAXED_CONTAINMENT, RELAXED_JACCARD, SAME_SIZE_JACCARD, duplicate_edges, strong_reach
from evidentia.storage import materialize

#: Thresholds of items of one language.
SAME_LANGUAGE_JACCARD, SAME_LANGUAGE_SIZE = SAME_SIZE_JACCARD, 12
#: Thresholds of items across languages stand in dedup; formulas shorter than this are too alike.
CROSS_LANGUAGE_SIZE = 11
#: Names of two formulas are compared all with all if they are at most so many times as many pairs as names (a name has some hundred keys), and meet by keys otherwise.
NAMES_COMPARED = 100


def item_sets(items: DataFrame, keys: DataFrame) -> DataFrame:
    """id, name, block, keys (sorted), n_links and n_placed of every item that has keys.

    items: id, name, block (brands of one group); keys: id, key, and placed (whether the link has a position).
    """
    sets = keys.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"), F.count("*").alias("n_links"), F.count_if("placed").alias("n_placed"))
    return sets.join(items.select("id", "name", "block"), "id").select("id", "name", "block", "keys", "n_links", "n_placed")


def _digest(keys: Column) -> Column:
    """SHA-256 of a sorted set, its keys told apart by their lengths."""
    text = F.transform(keys, lambda x: F.concat(F.length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")))
    return F.unhex(F.sha2(F.array_join(text, ""), 256))


def item_classes(sets: DataFrame) -> DataFrame:
    """`sets` (rows of item_sets with size and digest) without their keys, with class_id, the smallest id of those of one block and one set, and chinese."""
    narrow = sets.select("id", "name", "block", "size", "digest", "n_links", "n_placed", has_cjk(F.col("name")).alias("chinese"))
    return narrow.withColumn("class_id", F.min("id").over(Window.partitionBy("block", "digest"))).drop("digest")


def first_sets(sets: DataFrame, classed: DataFrame) -> DataFrame:
    """id, class_id, block, keys and size of the item that stands for each class. Sets stay where they are unless those of the others are too many to be sent out."""
    others = materialize(classed.where("id <> class_id and block is not null").select("id", "block").distinct(), "others")
    return sets.where("block is not null").join(others, ["id", "block"], "left_anti").select("id", F.col("id").alias("class_id"), "block", "keys", "size")


def formula_links(firsts: DataFrame) -> DataFrame:
    """u > v, jaccard, containment, cross and same of classes whose formulas are near enough for links across languages (cross) or of one language (same)."""
    strong = (F.col("jaccard") >= JACCARD) | ((F.col("jaccard") >= RELAXED_JACCARD) & (F.col("containment") >= RELAXED_CONTAINMENT))
    cross = strong & (F.col("containment") >= CONTAINMENT) & (F.abs(F.col("size_u") - F.col("size_v")) <= MAX_SIZE_DIFF)
    same = (F.col("jaccard") >= SAME_LANGUAGE_JACCARD) & (F.least("size_u", "size_v") >= SAME_LANGUAGE_SIZE)
    return duplicate_edges(firsts, cross | same, reach=strong_reach).withColumns({"cross": cross, "same": same}).select("u", "v", "jaccard", "containment", "cross", "same")


def cross_language_links(items: DataFrame, formulas: DataFrame) -> DataFrame:
    """u (Chinese), v, jaccard and containment of items that are each other's best across languages: by similarity, containment, number of links, smaller id."""
    side = lambda chinese, end: items.where(F.col("chinese") == chinese).where(F.col("size") >= CROSS_LANGUAGE_SIZE).groupBy("class_id").agg(
        F.min(F.struct((-F.col("n_links")).alias("rank"), F.col("id"))).alias("best")
    ).select(F.col("class_id").alias(f"class_{end}"), F.col("best.id").alias(end), F.col("best.rank").alias(f"rank_{end}"))
    formulas = formulas.where("cross")
    both = formulas.select("u", "v", *_rounded()).unionByName(formulas.select(F.col("v").alias("u"), F.col("u").alias("v"), *_rounded()))
    equal = items.select("class_id").distinct().select(F.col("class_id").alias("u"), F.col("class_id").alias("v"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("containment"))
    pairs = both.unionByName(equal).withColumnsRenamed({"u": "class_u", "v": "class_v"})
    met = pairs.join(side(True, "u"), "class_u").join(side(False, "v"), "class_v")
    best = lambda own, other: F.row_number().over(Window.partitionBy(f"class_{own}").orderBy(F.desc("jaccard"), F.desc("containment"), F.asc(f"rank_{other}"), F.asc(other)))
    return met.withColumns({"best_u": best("u", "v"), "best_v": best("v", "u")}).where("best_u = 1 and best_v = 1").select("u", "v", "jaccard", "containment")


def _rounded() -> list[Column]:
    return [F.round(x, 4).alias(x) for x in ("jaccard", "containment")]


def _shortened(word: Column) -> Column:
    """A word and all that is left of it without one letter or two."""
    without = lambda text: F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.concat(F.substring(text, F.lit(1), k - 1), F.substring(text, k + 1, F.length(text))))
    one = without(word)
    return F.array_distinct(F.concat(F.array(word), one, F.flatten(F.transform(F.filter(one, lambda x: x != ""), without))))


def name_keys(tokens: Column) -> Column:
    """The keys under which names meet that may be one name written twice; tokens: the sorted words of a name.

    Names of equal sets of words share the first. Names that differ in one word or two share one of the others: the rest of the words, and what the (first) differing word
    shortens to.
    """
    n = F.size(tokens)
    rest = lambda i, j: F.array_join(F.filter(tokens, lambda _, k: (k != i) & (k != j)), " ")
    keyed = lambda i, j: F.transform(_shortened(F.get(tokens, i)), lambda x: F.concat(F.when(i == j, F.lit("1")).otherwise(F.lit("2")), F.lit("|"), rest(i, j), F.lit("|"), x))
    near = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.flatten(F.transform(F.sequence(i, n - 1), lambda j: keyed(i, j)))))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("0|"), F.array_join(F.array_distinct(tokens), " "))), F.when(n > 0, near).otherwise(F.array().cast("array<string>"))))


def name_nodes(items: DataFrame) -> DataFrame:
    """node (the smallest id), class_id, name, tokens and members of the items of one formula and one multiset of words, in no Chinese."""
    latin = items.where(~F.col("chinese") & (F.col("size") >= SAME_LANGUAGE_SIZE)).withColumn("tokens", F.array_sort(name_tokens(F.col("name"))))
    return latin.groupBy("class_id", "tokens").agg(F.min("id").alias("node"), F.min_by("name", "id").alias("name"), F.count("*").alias("members"))


def same_language_links(nodes: DataFrame, formulas: DataFrame) -> DataFrame:
    """u > v and jaccard of nodes of nearly one formula and one name."""
    own = nodes.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class_id").alias("u"), F.col("class_id").alias("v"), F.lit(1.0).alias("jaccard"))
    pairs = own.unionByName(formulas.where("same").select("u", "v", "jaccard"))
    counts = nodes.groupBy("class_id").agg(F.count("*").alias("n"))
    of = lambda end: counts.select(F.col("class_id").alias(end), F.col("n").alias(f"n_{end}"))
    counted = materialize(pairs.join(of("u"), "u").join(of("v"), "v").withColumn("few", F.col("n_u") * F.col("n_v") <= NAMES_COMPARED * (F.col("n_u") + F.col("n_v"))), "pairs")
    pairs = counted.select("u", "v", "jaccard", "few")
    met = _compared(pairs.where("few"), nodes).unionByName(_met_by_keys(pairs.where("not few"), nodes))
    once = met.dropDuplicates(["a", "b"])
    return once.select(F.col("a").alias("u"), F.col("b").alias("v"), F.round("jaccard", 4).alias("jaccard"))


def _compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a > b and jaccard of nodes of one name, of pairs of formulas that have few nodes: all of one with all of the other."""
    of = lambda end, k: nodes.select(F.col("class_id").alias(end), F.col("node").alias(f"node_{k}"), F.col("name").alias(f"name_{k}"))
    both = pairs.join(of("u", 1), "u").join(of("v", 2), "v").where((F.col("u") != F.col("v")) | (F.col("node_1") > F.col("node_2")))
    first = F.col("node_1") > F.col("node_2")
    ends = [F.greatest("node_1", "node_2").alias("a"), F.least("node_1", "node_2").alias("b"), *[F.when(first, F.col(f"name_{x}")).otherwise(F.col(f"name_{y}")).alias(f"name_{z}") for x, y, z in ((1, 2, "a"), (2, 1, "b"))]]
    return both.select("jaccard", *ends).where(same_name(F.col("name_a"), F.col("name_b"))).select("a", "b", "jaccard")


def _met_by_keys(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same of pairs of formulas that have many nodes, by their names' keys."""
    placed = pairs.select("u", "v", "jaccard", F.explode(F.array_distinct(F.array("u", "v"))).alias("class_id"))
    keyed = materialize(placed.join(nodes, "class_id").select("u", "v", "jaccard", "class_id", "node", "name", F.explode(name_keys(F.col("tokens"))).alias("key")), "names")
    left = keyed.select("u", "v", "jaccard", "key", F.col("class_id").alias("class_a"), F.col("node").alias("a"), F.col("name").alias("name_a"))
    right = keyed.select(F.col("u").alias("u2"), F.col("v").alias("v2"), F.col("key").alias("key2"), F.col("class_id").alias("class_b"), F.col("node").alias("b"), F.col("name").alias("name_b"))
    here = (F.col("u") == F.col("u2")) & (F.col("v") == F.col("v2")) & (F.col("key") == F.col("key2")) & (F.col("a") > F.col("b"))
    # in a pair of formulas, names of one of them have met in its own group already
    met = left.join(right, here).where((F.col("u") == F.col("v")) | (F.col("class_a") != F.col("class_b")))
    once = met.select("a", "b", "jaccard", "name_a", "name_b").dropDuplicates(["a", "b"])
    return once.where(same_name(F.col("name_a"), F.col("name_b"))).select("a", "b", "jaccard")


def dedup_products(items: DataFrame, keys: DataFrame, order: list[Column] | None = None, sets: DataFrame | None = None) -> DataFrame:
    """id, cluster_id (the smallest id of those that are one product), place (1: the row that stays), n_cross and n_same (links by kind) of every item.

    items: id, name, block and own (whether it comes from the source that has positions); keys: id, key, placed. The row with the most links with a
    position stays, then with the most links, then of that source, then the smallest id. Items without keys are linked with none.
    sets: what item_sets gives for them, where it is known without bringing keys together; `keys` aren't read then.
    """
    sets = item_sets(items, keys) if sets is None else sets
    # sets are written once and never sorted or shuffled whole: classes are found by their digests
    sets = materialize(sets.where("id is not null").withColumns({"size": F.size("keys"), "digest": _digest(F.col("keys"))}), "sets_of_items")
    classed = materialize(item_classes(sets), "items")
    nodes = materialize(name_nodes(classed), "nodes")
    formulas = materialize(formula_links(first_sets(sets, classed)), "formulas")
    cross = materialize(cross_language_links(classed, formulas), "cross")
    same = materialize(same_language_links(nodes, formulas), "same")
    latin = classed.where(~F.col("chinese") & (F.col("size") >= SAME_LANGUAGE_SIZE)).withColumn("tokens", F.array_sort(name_tokens(F.col("name"))))
    members = latin.join(nodes.select("class_id", "tokens", "node", "members"), ["class_id", "tokens"]).select("id", "node", "members")
    inside = members.where(F.col("id") != F.col("node")).select(F.col("id").alias("u"), F.col("node").alias("v"))
    roots = components(cross.select("u", "v").unionByName(same.select("u", "v")).unionByName(inside))
    ends = same.select("u", "v").unionByName(same.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = ends.join(nodes.select(F.col("node").alias("v"), F.col("members").alias("other")), "v").groupBy(F.col("u").alias("node")).agg(F.sum("other").alias("others"))
    n_same = members.join(linked, "node", "left").select("id", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_same"))
    n_cross = cross.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n_cross"))
    found = items.select("id", F.coalesce("own", F.lit(False)).alias("own")).join(classed.select("id", "n_links", "n_placed"), "id", "left")
    found = found.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").join(n_same, "id", "left").join(n_cross, "id", "left")
    found = found.withColumn("cluster_id", F.coalesce("root", "id"))
    order = order or [F.desc_nulls_last("n_placed"), F.desc_nulls_last("n_links"), F.desc("own"), F.asc("id")]
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))
    count = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return found.select("id", "cluster_id", place.alias("place"), count("n_cross"), count("n_same"))


def in_groups(placed: DataFrame) -> DataFrame:
    """id of the items whose clusters have several rows; placed: id, cluster_id."""
    several = placed.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1")
    return placed.join(several, "cluster_id", "left_semi").select("id").distinct()


def merged_links(links: DataFrame, placed: DataFrame, fill: list[str]) -> DataFrame:
    """The links of the items that stay, their nulls in `fill` filled from links of merged items with the same key, nearest place first.

    links: id, key and other columns; placed: id, cluster_id, place. The links of the first item of a cluster that has any are kept, as those of the item that stays; keys that only others have
    aren't taken over. Of several links with one key all are filled.
    """
    keeper = placed.where("place = 1").select("cluster_id", F.col("id").alias("_keeper"))
    known = placed.select("id", "cluster_id", "place").join(keeper, "cluster_id")
    joined = links.join(known, "id")
    owner = joined.groupBy("cluster_id").agg(F.min("place").alias("_owner"))
    given = joined.groupBy("cluster_id", "key").agg(*[F.min_by(F.col(x), F.when(F.col(x).isNotNull(), F.col("place"))).alias(f"_{x}") for x in fill])
    kept = joined.join(owner, "cluster_id").where(F.col("place") == F.col("_owner")).join(given, ["cluster_id", "key"])
    return kept.select(*[F.col("_keeper").alias("id") if x == "id" else F.coalesce(x, f"_{x}").alias(x) if x in fill else F.col(x) for x in links.columns])


def majority_brands(items: DataFrame) -> DataFrame:
    """brand_from, brand_to and products of brands in two scripts whose Chinese or Latin part is a brand of more items; of two parts the one of more items, then the Chinese one.

    items: brand.
    """
    counts = items.where("brand is not null").groupBy("brand").agg(F.count("*").alias("products"))
    brand = F.col("brand")
    latin = F.btrim(F.regexp_replace(F.regexp_replace(brand, CJK, " "), r"\s+", " "))
    parts = F.array(F.struct(F.lit(0).alias("which"), F.regexp_replace(brand, f"[^{CJK[1:-1]}]", "").alias("part")), F.struct(F.lit(1).alias("which"), latin.alias("part")))
    double = counts.where(has_cjk(brand) & brand.contains(" ")).select("brand", "products", F.inline(parts)).where("part <> '' and part <> brand")
    known = counts.select(F.col("brand").alias("part"), F.col("products").alias("of_part"))
    best = double.join(known, "part").where(F.col("of_part") > F.col("products")).groupBy("brand", "products").agg(F.min(F.struct((-F.col("of_part")).alias("rank"), "which", "part")).alias("best"))
    return best.select(F.col("brand").alias("brand_from"), F.col("best.part").alias("brand_to"), "products")


def normalize_brands(items: DataFrame) -> DataFrame:
    """`items` with brands in two scripts under the name that more items have."""
    moves = majority_brands(items).select(F.col("brand_from").alias("brand"), "brand_to")
    # a row a brand; equal brands of many items don't meet in one task if it is small enough to be broadcast, and are split otherwise
    return items.join(moves, "brand", "left").select(*[F.coalesce("brand_to", "brand").alias("brand") if x == "brand" else F.col(x) for x in items.columns])
