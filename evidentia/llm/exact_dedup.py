"""Exact dedup by deterministic block naming.

Texts are compared after deleting white space. Every text is cut into fixed-size blocks of bytes; equal blocks get one
integer name by sorting them; then adjacent names are paired and the pairs named the same way, level by level, until
each text has one name. Two texts with as many blocks have equal names if and only if they are equal: no hash decides.

Scale: blocks that repeat within a task are sent once, so a group of copies of any size adds at most one row a task to
the sort. Block names are dense ranks inside hash buckets, so no key gathers more than its distinct values. Levels above
the first move only integers, and pairs are made distinct before they are named. Tables between the levels are
written to the shared folder.

Rows: one per input row, copies and repeated rows too. Null text counts as empty; all empty texts are one group. Null
doc_ids lose ties to others. Dropping goes by rows, not by doc_ids, so of each group one row stays, whatever ids repeat or are null. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.llm.common import SPACE_BYTES, text_or_empty
from evidentia.storage import materialize

BLOCK_BYTES = 4096
#: Bytes of distinct blocks that a task remembers; then it forgets them, and a block may be sent again.
REMEMBER_BYTES = 64 << 20
#: Naming buckets: many more than tasks, and few enough that bucket and rank fit in a long.
BUCKETS = 1 << 20


def _cut(id_type: T.DataType, block_bytes: int):
    schema = T.StructType(
        [
            T.StructField("rid", T.LongType()),
            T.StructField("doc_id", id_type),
            T.StructField("n_points", T.LongType()),
            T.StructField("text_sha256", T.StringType()),
            T.StructField("parts", T.ArrayType(T.LongType())),
            T.StructField("local", T.LongType()),
            T.StructField("block", T.BinaryType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        local = base
        seen: dict[bytes, int] = {}
        remembered = 0
        for batch in batches:
            shas, parts, fresh = [], [], {}
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                text = text.translate(None, SPACE_BYTES)
                shas.append(hashlib.sha256(text).hexdigest())
                own = []
                for at in range(0, len(text) or 1, block_bytes):
                    block = text[at : at + block_bytes]
                    name = seen.get(block)
                    if name is None:
                        name = seen[block] = local
                        fresh[local] = block
                        local += 1
                        remembered += len(block) + 100
                    own.append(name)
                parts.append(own)
            n, m = batch.num_rows, len(fresh)
            columns = [
                batch.column(2),
                batch.column(0),
                pa.compute.utf8_length(batch.column(1)).cast(pa.int64()),
                pa.array(shas, pa.string()),
                pa.array(parts, pa.list_(pa.int64())),
                pa.array([None] * n, pa.int64()),
                pa.array([None] * n, pa.binary()),
            ]
            names = [f.name for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if fresh:
                empty = [pa.nulls(m, c.type) for c in columns[:5]]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(fresh, pa.int64()), pa.array(fresh.values(), pa.binary())], names=names)
            if remembered > REMEMBER_BYTES:
                seen, remembered = {}, 0

    return cut, schema


def _named(distinct_rows: DataFrame, keys: list[str]) -> Column:
    """A name for each distinct value of `keys`: its bucket and its rank among the sorted values of the bucket."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    rank = F.dense_rank().over(Window.partitionBy(bucket).orderBy(*keys))
    return F.shiftleft(bucket, 40).bitwiseOR(rank.cast("long"))


def block_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rid, doc_id, n_points, text_sha256 of every row, with `n_blocks` and `name`, which are equal for equal texts only."""
    return _block_names(docs.select("doc_id", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("rid")), block_bytes)


def _block_names(rows: DataFrame, block_bytes: int) -> DataFrame:
    """The same for doc_id, text and rid, which differs from row to row."""
    cut, schema = _cut(rows.schema["doc_id"].dataType, block_bytes)
    table = materialize(rows.mapInArrow(cut, schema), "blocks")
    meta = table.where("rid is not null").select("rid", "doc_id", "n_points", "text_sha256", F.size("parts").cast("long").alias("n_blocks"))
    blocks = table.where("block is not null").select("local", "block")
    names = blocks.select("local", _named(blocks, ["block"]).alias("name"))
    places = table.where("rid is not null").select("rid", F.size("parts").cast("long").alias("n_blocks"), F.posexplode("parts").alias("pos", "local"))
    level = materialize(places.join(names, "local").select("rid", "n_blocks", F.col("pos").cast("long").alias("pos"), "name"), "names")
    done = level.where("n_blocks = 1").select("rid", "name")
    widest = level.agg(F.max("n_blocks")).first()[0] or 1
    before, span = 1, 1
    while span < widest:
        open_rows = level if before == 1 else level.where(F.col("n_blocks") > before)
        open_rows = open_rows.where("n_blocks > 1")
        pairs = open_rows.groupBy("rid", "n_blocks", F.expr("pos div 2").alias("half")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        distinct = pairs.select("left", "right").distinct()
        named = distinct.select("left", "right", _named(distinct, ["left", "right"]).alias("name"))
        level = materialize(pairs.join(named, ["left", "right"]).select("rid", "n_blocks", F.col("half").alias("pos"), "name"), "names")
        before, span = span, span * 2
        done = done.unionByName(level.where((F.col("n_blocks") > before) & (F.col("n_blocks") <= span)).select("rid", "name"))
        before = span
    return meta.join(done, "rid")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Of equal texts the row with the most code points in its own text stays, then the smallest doc_id (nulls last).
    """
    return _groups(block_names(docs, block_bytes)).drop("rid")


def _groups(names: DataFrame) -> DataFrame:
    """The same with rid, from block names."""
    named = materialize(names, "named")
    first = F.min(F.struct((-F.col("n_points")).alias("points"), F.col("doc_id").isNull().alias("absent"), "doc_id", "rid"))
    # written, so that the join below reads both sides anew and a group of very many copies can be split there
    groups = materialize(named.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), first.alias("first")), "groups")
    return named.join(groups, ["n_blocks", "name"]).select(
        "rid",
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one row of each group of equal texts."""
    # written with the ids of its rows, so that they are the same for both readers
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("own")), "rows")
    texts = rows.select("own.doc_id", text_or_empty("own.text").alias("text"), "rid")
    gone = _groups(_block_names(texts, block_bytes)).where(~F.col("kept")).select("rid")
    return rows.join(gone, "rid", "left_anti").select("own.*")
