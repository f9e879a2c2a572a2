"""Nearest neighbours of dense vectors, sparse profiles of ordered lists, and measures over neighbour lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.operators.dealing import dealt, parts_of
from evidentia.operators.similarity import distinct_components, paired, top
from evidentia.storage import materialize

#: Query vectors of one block: what is broadcast at once is bounded by it, whatever the number of queries.
BLOCK_ROWS = 4096
#: Scores that a task holds at once, 8 bytes each (and as much again for their ids, order and copies).
SCORES_AT_ONCE = 1 << 20


def _block_best(ids: np.ndarray, vectors: np.ndarray, k: int, decimals: int):
    """Running top k of each query of a block over a task's rows; at most SCORES_AT_ONCE scores are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids, best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        step = max(1, SCORES_AT_ONCE // len(ids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                own = part.column(0).to_numpy(zero_copy_only=False)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                scores = np.round(vectors @ flat.reshape(len(own), -1).T, decimals)
                scores[ids[:, None] == own[None, :]] = -np.inf
                if best.shape[1] == k:
                    # only rows that are as good as some query's k-th so far can change its list
                    some = ~(scores < best[:, -1:]).all(axis=0)
                    if not some.any():
                        continue
                    own, scores = own[some], scores[:, some]
                best = np.concatenate([best, scores], 1)
                best_ids = np.concatenate([best_ids, np.broadcast_to(own, scores.shape)], 1)
                order = np.lexsort((best_ids, -best), axis=1)[:, :k]
                best, best_ids = np.take_along_axis(best, order, 1), np.take_along_axis(best_ids, order, 1)
        kept = np.isfinite(best)
        rows = np.nonzero(kept)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(best_ids[kept]), pa.array(best[kept])], names=["query_id", "id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, decimals: int = 6) -> DataFrame:
    """query_id, id, rank, score: the k largest inner products of each query with other rows; ties by id.

    rows, queries: columns id (long) and vector (array of equal length, no nulls). Rows are read once for each block of
    queries, and each task sends k rows a query; nothing else is shuffled.
    """
    blocks = max(1, -(-queries.count() // block_rows))
    found = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", F.col("vector").cast("array<double>").alias("vector")).toArrow()
        ids = own["id"].to_numpy()
        if not len(ids):
            continue
        vectors = np.array(own["vector"].to_pylist(), dtype=np.float64)
        part = rows.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(_block_best(ids, vectors, k, decimals), "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, id long, rank int, score double")
    return top(found, "query_id", k, F.desc("score"), F.asc("id")).select("query_id", "id", "rank", "score")


def pooled_nearest(rows: DataFrame, pool: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Neighbours among the ids of `pool` only."""
    return nearest(rows.join(pool.select("id"), "id", "left_semi"), queries, k)


def tf_idf(links: DataFrame) -> DataFrame:
    """product_id, ingredient_id, weight: times listed by ln(items / items that list it); no smoothing."""
    times = dealt(links.select("product_id", "ingredient_id"), parts_of(links), "product_id").groupBy("product_id", "ingredient_id").agg(F.count("*").alias("times"))
    # read by the number of items, the spreads and the weights
    times = materialize(times, "times")
    n_items = times.select(F.count_distinct("product_id").alias("n")).scalar()
    spread = times.groupBy("ingredient_id").agg(F.count("*").alias("spread"))
    weighed = times.join(spread.hint("shuffle_hash"), "ingredient_id").select("product_id", "ingredient_id", (F.col("times") * F.ln(n_items / F.col("spread"))).alias("weight"))
    return weighed.where("weight > 0")


def rank_decay(links: DataFrame) -> DataFrame:
    """Weights that fall with the position in the list, 1/log2(position + 1); of repeated components the highest."""
    placed = dealt(links.where("position is not null").select("product_id", "ingredient_id", "position"), parts_of(links), "product_id").groupBy("product_id", "ingredient_id").agg(F.min("position").alias("position"))
    return placed.select("product_id", "ingredient_id", (1 / F.log2(F.col("position") + 1.0)).alias("weight"))


def one_hot(links: DataFrame) -> DataFrame:
    """Weight 1 for each component of an item, however often it is listed."""
    return distinct_components(links).withColumn("weight", F.lit(1.0))


def hybrid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both vectors side by side, each of length 1 and then weighed by the root of a half, so that cosines are averaged; components are told apart by their side."""

    def side(rows: DataFrame, k: int) -> DataFrame:
        rows = materialize(rows, "side")
        length = rows.groupBy("product_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
        weight = F.lit(0.5**0.5) * F.col("weight") / F.col("length")
        return rows.join(length.hint("shuffle_hash"), "product_id").select("product_id", (F.col("ingredient_id") * 2 + k).alias("ingredient_id"), weight.alias("weight"))

    return side(a, 0).unionByName(side(b, 1))


def cosine_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, product_id, rank, score: the nearest items by cosine of their sparse vectors."""
    pairs = paired(vectors, queries, F.col("query_weight") * F.col("weight"), "dot")
    scored = pairs.withColumn("score", F.round(F.col("dot") / (F.col("query_norm") * F.col("norm")), 4)).where("score > 0")
    return top(scored, "query_id", k, F.desc("score"), F.asc("product_id")).select("query_id", "product_id", "rank", "score")


def label_agreement(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """For each query: neighbours, and the share of them that have its label; labels: id, label."""
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    joined = neighbours.join(labels.select("id", "label"), "id").join(own, "query_id")
    return joined.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 4).alias("label_rate"))


def cheaper_alternatives(neighbours: DataFrame, overlap: DataFrame, items: DataFrame, least_jaccard: float = 0.5) -> DataFrame:
    """For each query item of at least the median price: the cheaper neighbour with the most shared components, and what it saves.

    neighbours: query_id, product_id; overlap: query_id, product_id, jaccard; items: product_id, brand, price.
    """
    median = items.select(F.percentile("price", F.lit(0.5)).alias("median")).scalar()
    priced = items.where("price is not null").select("product_id", "brand", "price")
    premium = priced.where(F.col("price") >= median).select(F.col("product_id").alias("query_id"), F.col("brand").alias("query_brand"), F.col("price").alias("query_price"))
    near = neighbours.select("query_id", "product_id").join(overlap.select("query_id", "product_id", "jaccard"), ["query_id", "product_id"])
    cheaper = near.join(priced, "product_id").join(premium, "query_id").where((F.col("price") < F.col("query_price")) & (F.col("jaccard") >= least_jaccard))
    best = top(cheaper, "query_id", 1, F.desc("jaccard"), F.asc("product_id"))
    saving = F.round((F.col("query_price") - F.col("price")) / F.col("query_price"), 4)
    found = best.select("query_id", "product_id", F.round("jaccard", 4).alias("jaccard"), saving.alias("saving"), (F.col("brand") != F.col("query_brand")).alias("cross_brand"))
    return premium.join(neighbours.select("query_id").distinct(), "query_id", "left_semi").select("query_id").join(found, "query_id", "left")


def list_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each query: Jaccard of two neighbour lists, shared neighbours, and Spearman's correlation of their places among the shared.

    The correlation is null with fewer than two shared neighbours, or where all stand in one place.
    """
    left = a.select("query_id", "product_id", F.col("rank").alias("rank_a"))
    right = b.select("query_id", "product_id", F.col("rank").alias("rank_b"))
    both = left.join(right, ["query_id", "product_id"], "full")
    shared = F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull()
    place = lambda name: F.row_number().over(Window.partitionBy("query_id", "shared").orderBy(name)).cast("double")
    placed = both.withColumn("shared", shared).withColumns({"pa": F.when(F.col("shared"), place("rank_a")), "pb": F.when(F.col("shared"), place("rank_b"))})
    n = F.count("pa")
    distance = F.sum((F.col("pa") - F.col("pb")) * (F.col("pa") - F.col("pb")))
    spearman = F.when(n >= 2, 1 - 6 * distance / (n * (n * n - 1)))
    return placed.groupBy("query_id").agg(F.round(n / F.count("*"), 4).alias("jaccard"), n.alias("shared"), F.round(spearman, 4).alias("spearman"))


def place_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each query: Pearson's correlation of the places of the neighbours that both lists have; null with fewer than two, or where a list's places don't differ."""
    right = b.select("query_id", "product_id", F.col("rank").alias("rank_b"))
    both = a.select("query_id", "product_id", F.col("rank").alias("rank_a")).join(right, ["query_id", "product_id"])
    varied = (F.count("*") >= 2) & (F.min("rank_a") < F.max("rank_a")) & (F.min("rank_b") < F.max("rank_b"))
    return both.groupBy("query_id").agg(F.count("*").alias("shared"), F.when(varied, F.round(F.corr("rank_a", "rank_b"), 4)).alias("pearson"))


def percentiles(rows: DataFrame, value: str, shares: list[float]) -> Column:
    """Exact percentiles with linear interpolation, as an aggregate."""
    return F.percentile(value, F.array(*map(F.lit, shares)))


def linear_probe(features: Column, weights: list[float], bias: float, high: float = 0.7, low: float = 0.3) -> tuple[Column, Column]:
    """The sigmoid of a linear probe over a feature array, and its class: generated, real or uncertain."""
    weighed = F.zip_with(features.cast("array<double>"), F.array(*map(F.lit, weights)), lambda x, w: x * w)
    score = 1 / (1 + F.exp(-(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x) + F.lit(bias))))
    return score, F.when(score >= high, "generated").when(score <= low, "real").otherwise("uncertain")
