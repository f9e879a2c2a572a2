"""Duplicate items: set-similarity edges within blocks, clusters, keepers, and merging with repointed children.

Equal sets are one class first. Tokens fall into parts by their hashes, one part more than the tokens that two similar sets may differ in, so such sets
have at least one part in common, whole. Classes meet by whole parts, which loses no pair above the threshold and pairs no others but those that agree in
several tokens at once; how often a token occurs doesn't matter. Pairs that met are compared in groups that their sets are sent to once, so that no pair carries its sets along.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.operators.components import components
from evidentia.storage import materialize

#: Thresholds of duplicate items.
JACCARD, RELAXED_JACCARD, RELAXED_CONTAINMENT, CONTAINMENT, MAX_SIZE_DIFF, MIN_SIZE = 0.90, 0.85, 0.96, 0.93, 2, 11
#: Sets that are compared with one another in one group, about, and tokens of theirs that a matrix holds.
SETS_AT_ONCE, TOKENS_AT_ONCE = 512, 4096
#: Sets that differ in size by more than MAX_SIZE_DIFF are linked from this similarity on, if at all (items of one language).
SAME_SIZE_JACCARD = 0.98


def set_classes(keys: DataFrame) -> DataFrame:
    """id, block, keys (sorted), size and class_id, the smallest id with the same block and keys; keys: id, block, key."""
    sets = keys.groupBy("id", "block").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    own = Window.partitionBy("block", "keys")
    return sets.withColumns({"class_id": F.min("id").over(own), "size": F.size("keys")})


def strong_reach(size: int) -> tuple[int, int]:
    """For the links of duplicate items, here and in product_dedup: the most tokens of a set whose partner has `size`, and the most tokens that the two differ in if `size` is the larger."""
    by_jaccard = 2 * size * (1 - JACCARD) / (1 + JACCARD)
    relaxed = min(MAX_SIZE_DIFF + 2 * (1 - RELAXED_CONTAINMENT) * size, 2 * size * (1 - RELAXED_JACCARD) / (1 + RELAXED_JACCARD))
    return max(size + MAX_SIZE_DIFF, math.floor(size / SAME_SIZE_JACCARD + 1e-9)), math.floor(max(by_jaccard, relaxed) + 1e-9)


def jaccard_reach(least_jaccard: float) -> Callable[[int], tuple[int, int]]:
    """The same for all sets of at least this similarity."""
    return lambda size: (math.floor(size / least_jaccard + 1e-9), math.floor(2 * size * (1 - least_jaccard) / (1 + least_jaccard) + 1e-9))


def _levels(reach: Callable[[int], tuple[int, int]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest sizes of levels up to `most` tokens, and the number of parts of each."""
    ends = [8]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 4, ends[-1] * 8 // 7))
    return np.array(ends), np.array([reach(x)[1] + 1 for x in ends])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _parts(reach: Callable[[int], tuple[int, int]], id_type: T.DataType, tokens_at_once: int = 1 << 20):
    """A row for each part of each set: a key of the part's tokens, and of the set its id, size and 128 bits that differ in no more places than the sets in tokens.

    A pair meets at the level of its larger set, so a set has parts at its own level and at those of the larger sets it may pair with.
    """
    kinds = (("part", T.LongType()), ("id", id_type), ("size", T.IntegerType()), ("bits", T.LongType()), ("more_bits", T.LongType()))
    schema = T.StructType([T.StructField(k, t) for k, t in kinds])

    def rows(ids: pa.Array, blocks: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        most = np.array([reach(int(x))[0] for x in sizes])
        ends, n_parts = _levels(reach, int(most.max()))
        first, last = np.searchsorted(ends, sizes), np.searchsorted(ends, most)
        set_of = np.repeat(np.arange(len(sizes)), last - first + 1)
        level = first[set_of] + np.arange(len(set_of)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
        parts, n = n_parts[level], sizes[set_of]
        # every token of every set at every level of the set
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        token = hashes[np.repeat((np.cumsum(sizes) - sizes)[set_of], n) + place]
        start = np.cumsum(parts) - parts
        found = np.zeros(parts.sum(), np.uint64)
        np.bitwise_xor.at(found, np.repeat(start, n) + (token % np.repeat(parts, n).astype(np.uint64)).astype(np.int64), token)
        which = np.arange(len(found)) - np.repeat(start, parts)
        key = _mixed(found + _mixed(np.repeat(blocks[set_of], parts) + _mixed((np.repeat(level, parts) << 32 | which).astype(np.uint64))))
        bit, one = (hashes >> np.uint64(50)) & np.uint64(127), np.uint64(1)
        bits = np.zeros((2, len(sizes)), np.uint64)
        np.bitwise_xor.at(bits, ((bit >> np.uint64(6)).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)), one << (bit & np.uint64(63)))
        owner = np.repeat(set_of, parts)
        columns = [pa.array(key.view(np.int64)), ids.take(pa.array(owner)), pa.array(sizes[owner].astype(np.int32)), *[pa.array(x[owner].view(np.int64)) for x in bits]]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            blocks, ends, at = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(sizes), 0
            while at < len(sizes):
                begin = int(ends[at] - sizes[at])
                to = max(at + 1, int(np.searchsorted(ends, begin + tokens_at_once, "right")))
                yield rows(batch.column(0).slice(at, to - at), blocks[at:to], sizes[at:to], hashes[begin : int(ends[to - 1])])
                at = to

    return run, schema


def _shared(id_type: T.DataType, block_type: T.DataType, least_jaccard: float):
    """The pairs of a group of sets that are similar enough, with their sizes, block and number of common tokens: x, y, in no order."""
    kinds = (("x", id_type), ("y", id_type), ("size_x", T.IntegerType()), ("size_y", T.IntegerType()), ("block", block_type), ("shared", T.IntegerType()))
    schema = T.StructType([T.StructField(k, t) for k, t in kinds])

    def count(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, blocks, keys = (group.column(k).combine_chunks() for k in ("id", "block", "keys"))
        codes = keys.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        sizes = np.diff(keys.offsets.to_numpy())
        # only tokens of several sets count; they are taken in slices, so that a matrix holds few
        times = np.bincount(codes, minlength=1)
        place = np.cumsum(times > 1) - 1
        owner, kept = np.repeat(np.arange(len(sizes)), sizes), times[codes] > 1
        owner, codes = owner[kept], place[codes[kept]]
        order = np.argsort(codes, kind="stable")
        owner, codes = owner[order], codes[order]
        shared = np.zeros((len(sizes), len(sizes)), np.float32)
        for start in range(0, int(place[-1]) + 1 if len(place) else 0, TOKENS_AT_ONCE):
            here = slice(*np.searchsorted(codes, (start, start + TOKENS_AT_ONCE)))
            has = np.zeros((len(sizes), min(TOKENS_AT_ONCE, int(place[-1]) + 1 - start)), np.float32)
            has[owner[here], codes[here] - start] = 1
            shared += has @ has.T
        of = blocks.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        alike = (shared >= (least_jaccard - 1e-9) * (sizes[:, None] + sizes - shared)) & (of[:, None] == of)
        x, y = np.nonzero(np.triu(alike, 1))
        columns = [ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(sizes[x].astype(np.int32)), pa.array(sizes[y].astype(np.int32)), blocks.take(pa.array(x)), pa.array(shared[x, y].astype(np.int32))]
        return pa.Table.from_arrays(columns, names=schema.names)

    return count, schema


def duplicate_edges(
    classes: DataFrame, accept: Column | None = None, least_jaccard: float = RELAXED_JACCARD, min_size: int = MIN_SIZE, reach: Callable[[int], tuple[int, int]] | None = None
) -> DataFrame:
    """Edges (u > v) of class representatives, with jaccard and containment, that `accept` takes.

    accept: a condition over jaccard, containment, size_u and size_v that implies jaccard >= least_jaccard, and what `reach` says of sizes and differences, if given.
    """
    if accept is None:
        strong = (F.col("jaccard") >= JACCARD) | ((F.col("jaccard") >= RELAXED_JACCARD) & (F.col("containment") >= RELAXED_CONTAINMENT))
        accept = strong & (F.col("containment") >= CONTAINMENT) & (F.abs(F.col("size_u") - F.col("size_v")) <= MAX_SIZE_DIFF)
        reach = reach or strong_reach
    firsts = classes.where((F.col("id") == F.col("class_id")) & (F.col("size") >= min_size) & F.col("block").isNotNull()).select("id", "block", "keys", "size")
    split, schema = _parts(reach or jaccard_reach(least_jaccard), firsts.schema["id"].dataType)
    hashed = firsts.where("size > 0").select("id", F.xxhash64("block").alias("block"), F.transform("keys", lambda x: F.xxhash64(x)).alias("hashes"), "size")
    # most parts are found once
    met = F.count("*").over(Window.partitionBy("part"))
    parts = materialize(hashed.mapInArrow(split, schema).withColumn("met", met).where("met > 1").drop("met"), "parts")
    side = lambda name: parts.select("part", F.col("id").alias(name), *[F.col(x).alias(f"{x}_{name}") for x in ("size", "bits", "more_bits")])
    differ = lambda x: F.bit_count(F.col(f"{x}_u").bitwiseXOR(F.col(f"{x}_v")))
    total = F.col("size_u") + F.col("size_v")
    near = (F.col("size_u") >= least_jaccard * F.col("size_v") - 1e-9) & (F.col("size_v") >= least_jaccard * F.col("size_u") - 1e-9)
    near = near & (differ("bits") + differ("more_bits") <= (1 - least_jaccard) / (1 + least_jaccard) * total + 1e-9)
    met = side("u").join(side("v"), "part").where((F.col("u") > F.col("v")) & near)
    # a pair that meets in several parts is compared in one of them, beside the other pairs of that part
    candidates = materialize(met.groupBy("u", "v").agg(F.min("part").alias("part")), "candidates")
    placed = F.explode(F.array("u", "v")).alias("id")
    large = candidates.select("part", placed).distinct().groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > SETS_AT_ONCE)
    large = materialize(large.select("part", F.ceil(2 * F.col("n") / SETS_AT_ONCE).alias("shares")), "large_parts")
    share = lambda x: F.coalesce(F.pmod(F.xxhash64(x), F.col("shares")), F.lit(0).cast("long"))
    dealt = candidates.join(large, "part", "left").withColumns({"one": F.least(share("u"), share("v")), "other": F.greatest(share("u"), share("v"))})
    members = materialize(dealt.select("part", "one", "other", placed).distinct(), "members")
    # written, so that their size is known: few ends are sent to the sets then, and no set is shuffled to be left out
    ends = materialize(members.select("id").distinct(), "ends")
    sets = materialize(firsts.join(ends, "id", "left_semi"), "sets")
    count, counted = _shared(firsts.schema["id"].dataType, firsts.schema["block"].dataType, least_jaccard)
    compared = members.join(sets, "id").select("part", "one", "other", "id", "block", "keys").groupBy("part", "one", "other").applyInArrow(count, counted).where("x <> y")
    first = F.col("x") > F.col("y")
    ordered = [F.when(first, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("x", "y", "u"), ("y", "x", "v"), ("size_x", "size_y", "size_u"), ("size_y", "size_x", "size_v"))]
    measured = compared.select(*ordered, "block", "shared").distinct().select(
        "u", "v", "size_u", "size_v", (F.col("shared") / (F.col("size_u") + F.col("size_v") - F.col("shared"))).alias("jaccard"), (F.col("shared") / F.least("size_u", "size_v")).alias("containment")
    )
    return measured.where(accept)


def mutual_best(edges: DataFrame) -> DataFrame:
    """The edges that are the best of both their ends: by jaccard, containment, then the smaller id of the other end."""
    best = lambda end, other: F.row_number().over(Window.partitionBy(end).orderBy(F.desc("jaccard"), F.desc("containment"), F.asc(other)))
    return edges.withColumns({"best_u": best("u", "v"), "best_v": best("v", "u")}).where("best_u = 1 and best_v = 1").drop("best_u", "best_v")


def duplicate_clusters(keys: DataFrame, least_jaccard: float = RELAXED_JACCARD, min_size: int = MIN_SIZE) -> DataFrame:
    """id, class_id, cluster_id (the smallest id reachable) and n_links (edges of its class) of every item."""
    classes = materialize(set_classes(keys), "classes")
    edges = materialize(duplicate_edges(classes, None, least_jaccard, min_size), "edges")
    roots = components(edges.select("u", "v"))
    ends = edges.select(F.explode(F.array("u", "v")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    named = classes.select("id", "class_id").join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left").join(ends, "class_id", "left")
    return named.select("id", "class_id", F.coalesce("root", "class_id").alias("cluster_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keepers(clusters: DataFrame, order: list[Column]) -> DataFrame:
    """`clusters` with place, 1 for the row of each cluster that stays."""
    return clusters.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order)))


def merge_items(items: DataFrame, placed: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """The keepers of `items`, their nulls in `fill` filled from the other members, nearest place first.

    placed: key, cluster_id, place. Items in no cluster stay as they are.
    """
    joined = items.join(placed.select(key, "cluster_id", "place"), key, "left")
    group = Window.partitionBy(F.coalesce("cluster_id", key)).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = joined.withColumns({name: F.coalesce(F.col(name), F.first(name, ignorenulls=True).over(group)) for name in fill})
    return filled.where("place is null or place = 1").select(*items.columns)


def repoint(children: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """Children of merged items, now of their keepers."""
    keeper = placed.where("place = 1").select("cluster_id", F.col(key).alias("_keeper"))
    moved = placed.select(key, "cluster_id").join(keeper, "cluster_id").select(key, "_keeper")
    return children.join(moved, key, "left").withColumn(key, F.coalesce("_keeper", key)).drop("_keeper")


def expected_prefix(size: int, threshold: float) -> int:
    """Tokens of a set that are looked up: any set at least `threshold` similar shares one of them."""
    return size - math.ceil(threshold * size - 1e-9) + 1
