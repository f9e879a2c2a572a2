"""SimHash near-dedup by multi-index hashing.

Fingerprints are taken in Arrow functions and made distinct. Each is cut into two segments of 32 bits. Two fingerprints
with 3 or fewer differing bits have a segment where they differ in at most one bit, so each fingerprint looks up, in the
table of that segment, its own value and the values with one more bit set (of two that differ in one bit, one has it
unset); what is found is verified by the complete distance.

Segments shared by more than HOT distinct fingerprints (clouds around texts with very many near copies) would give all pairs.
There a linear way finds the same components: each fingerprint stands at the values of the other segment around its own,
as near (0 or 1 bit) or far (2 bits); whatever stands where a near one stands is within 3 bits of it, and any two within 3
bits meet so at some value. So every row of such a place is linked with the place's least near one.

Rows: one per input row. Null text counts as empty: fingerprint zero, linked like any other. Ties don't arise: a component
is named by its smallest doc_id (nulls aside; null if it has none). Repeated rows share a fingerprint. Dropping goes by rows, not by
doc_ids: of each component one row stays, whatever ids repeat or are null. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import text_or_empty
from evidentia.operators.components import components
from evidentia.storage import materialize

SHINGLE_WORDS, SEED, MOST_BITS = 3, 42, 3
#: Distinct fingerprints that share a segment, from which on they aren't compared in pairs.
HOT = 64
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The majority of each bit over the XXH64 of all shingles of the text, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxh64_intdigest(b" ".join(words), seed)
    shingles = map(b" ".join, zip(*[words[k:] for k in range(shingle_words)]))
    hashes = np.array([xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a (signed) long, of every row."""
    return _fingerprints(docs.select("doc_id", text_or_empty().alias("text")))


def _fingerprints(rows: DataFrame) -> DataFrame:
    """All columns of `rows` but the text, and fp."""
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), T.StructField("fp", T.LongType())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text) for text in batch.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield batch.drop_columns(["text"]).append_column("fp", pa.array(found.view(np.int64)))

    return rows.mapInArrow(take, schema)


def _bit(k) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _flips(value: Column) -> Column:
    """The values that differ from a 32-bit value in one bit."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: value.bitwiseXOR(_bit(k)))


def _near(value: Column) -> Column:
    return F.concat(F.array(value), _flips(value))


def _far(value: Column) -> Column:
    """The values that differ in two bits."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.lit(31)),
        lambda i: F.transform(F.sequence(F.lit(0), i - 1), lambda j: value.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(j))),
    )
    return F.flatten(pairs)


def _within(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS


def fingerprint_links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (u, v) of fingerprints within MOST_BITS, enough of them to connect all that such links connect.

    distinct: a column fp of different longs. Segments of up to `hot` fingerprints give every link.
    """
    mask = F.lit(0xFFFFFFFF).cast("long")
    low, high = F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", 32)
    side = lambda k, own, other: F.struct(F.lit(k).alias("side"), own.alias("seg"), other.alias("rest"))
    segments = distinct.select("fp", F.inline(F.array(side(0, low, high), side(1, high, low))))
    crowded = segments.groupBy("side", "seg").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("side", "seg", F.lit(True).alias("hot"))
    crowded = materialize(crowded, "crowded")
    segments = materialize(segments.join(crowded, ["side", "seg"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "segments")

    cold = segments.where("not hot")
    more = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.col("seg").bitwiseOR(_bit(k))), lambda x: x != F.col("seg"))
    probes = cold.select("side", F.col("fp").alias("u"), "seg", F.explode(F.concat(F.array("seg"), more)).alias("key"))
    table = cold.select("side", F.col("seg").alias("key"), F.col("fp").alias("v"))
    links = probes.join(table, ["side", "key"]).where(_within("u", "v") & ((F.col("seg") != F.col("key")) | (F.col("u") < F.col("v")))).select("u", "v")
    if crowded.isEmpty():
        return links

    inside = segments.where("hot").select("side", F.col("seg").alias("key"), "fp", "rest")
    beside = segments.select("side", "fp", "rest", F.explode(_flips(F.col("seg"))).alias("key")).join(crowded.select("side", F.col("seg").alias("key")), ["side", "key"])
    near = inside.select("side", "key", "fp", F.explode(_near(F.col("rest"))).alias("at"))
    others = inside.select("side", "key", "fp", F.explode(_far(F.col("rest"))).alias("at")).unionByName(beside.select("side", "key", "fp", F.explode(_near(F.col("rest"))).alias("at")))
    least = near.groupBy("side", "key", "at").agg(F.min("fp").alias("v"))
    met = near.unionByName(others).join(least, ["side", "key", "at"]).where(F.col("fp") != F.col("v")).select(F.col("fp").alias("u"), "v")
    return links.unionByName(met.distinct())


def _classes(taken: DataFrame, hot: int) -> DataFrame:
    """fp and root, equal for what links connect, from written fingerprints; roots are fingerprints."""
    distinct = taken.select("fp").distinct()
    roots = components(fingerprint_links(distinct, hot))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return materialize(named, "named")


def simhash_components(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    taken = materialize(fingerprints(docs), "fingerprints")
    named = _classes(taken, hot)
    first = taken.groupBy("fp").agg(F.min("doc_id").alias("first")).join(named, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(first, "root").select("fp", "component_id")
    return taken.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, hot: int = HOT, from_files: bool = False) -> DataFrame:
    """One row of each component with all columns: the first with its smallest doc_id (nulls last), whatever ids repeat.

    Rows are told apart by ids that are written with them. from_files says that `docs` is what some files hold, row by row: then a row
    is told by its file and its place there, and no text is written.
    """
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    own = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("own")
    try:
        if not from_files or "_metadata" in docs.columns:
            raise ValueError
        rows = docs.select(*place, own)
    except (ValueError, AnalysisException):
        rows = materialize(docs.select(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"), own), "rows")
    taken = materialize(_fingerprints(rows.select("file", "row", "own.doc_id", text_or_empty("own.text").alias("text"))), "fingerprints")
    of_fp = taken.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "file", "row")).alias("first"))
    kept = of_fp.join(_classes(taken, hot), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.file", "first.row")
    return rows.join(materialize(kept, "kept"), ["file", "row"], "left_semi").select("own.*")
