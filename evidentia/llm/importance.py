"""Resampling towards a target distribution, with hashed n-gram features whose CRCs are composed, not computed anew.

A feature is a run of 1 to n words joined by one space; its bucket is the CRC-32 of its bytes modulo `buckets`. Each word's CRC is
computed once. With crc(AB) = Z(|B|) crc(A) xor crc(B), where Z(k) is the matrix over GF(2) that appends k zero bytes, the CRC of
a run follows from that of the run without its last word, so no n-gram is ever written as a string. Z(k) comes from squaring the
matrix of one byte, and is kept as four tables of 256 entries.

Counts by bucket are taken in each task (at most `buckets` rows leave it) and added. A bucket's gain, in thousandths, is the logarithm
of its smoothed share in the target over that in the source; a document's weight is the mean gain of its features. A draw without
replacement takes the highest sums of weight and Gumbel noise, which is a hash of seed and doc_id; ranks come from a range-partitioned sort.
The driver holds the gains: `buckets` numbers, whatever the input.

Rows: one per input row, repeated rows too (each is drawn on its own; they have equal scores and different ranks). Null and empty texts have no
features, weight 0, and are never drawn. Very long texts are read in pieces of whole words, so memory follows the longest word. Ties go to the
smaller doc_id; a null doc_id counts as empty text in the noise and comes last among ties. Other columns are ignored. Empty
tables give empty results; an empty target has smoothed counts only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import text_or_empty
from evidentia.operators.ordering import numbered
from evidentia.storage import materialize

MOST_WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of a text that are cut into words at once, and features counted at once.
PIECE, COUNTED = 1 << 20, 1 << 20
#: Fixed value: the polynomial of CRC-32, bits reversed.
POLYNOMIAL = 0xEDB88320
#: Letters and digits of ASCII stand for themselves in lower case, other ASCII characters separate words, other bytes stay.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), as the images of the 32 bits, times each value."""
    out = np.zeros(values.shape, dtype=np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0)).astype(np.uint32)
    return out


def _one_byte() -> np.ndarray:
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        columns = columns >> np.uint32(1) ^ np.where(columns & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0)).astype(np.uint32)
    return columns


@lru_cache(maxsize=4096)
def zero_bytes(length: int) -> np.ndarray:
    """The tables of Z(length): entry [k, b] is the image of byte b at place k."""
    power, columns = _one_byte(), np.uint32(1) << np.arange(32, dtype=np.uint32)
    while length:
        if length & 1:
            columns = apply(power, columns)
        power, length = apply(power, power), length >> 1
    bytes_ = np.arange(256, dtype=np.uint32)
    return np.stack([apply(columns, bytes_ << np.uint32(8 * k)) for k in range(4)])


def lengthened(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC times the matrix of its length."""
    out = np.empty_like(crcs)
    for length in np.unique(lengths):
        at = lengths == length
        table, value = zero_bytes(int(length)), crcs[at]
        out[at] = table[0][value & 255] ^ table[1][value >> 8 & 255] ^ table[2][value >> 16 & 255] ^ table[3][value >> 24]
    return out


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces of about PIECE bytes that end where a word ends."""
    begin = 0
    while begin < len(text):
        end = min(begin + PIECE, len(text))
        parts = [text[begin:end].translate(FOLDED)]
        open_word = not parts[0].endswith(b" ")
        while open_word and end < len(text):
            more = text[end : end + PIECE].translate(FOLDED)
            rest, space, _ = more.partition(b" ")
            parts.append(rest)
            end += len(rest)
            open_word = not space
        yield b"".join(parts).split()
        begin = end


def feature_crcs(text: bytes, most_words: int = MOST_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words and the CRC-32 of all runs of 1 to most_words words of the text, piece by piece."""
    crcs = lengths = np.empty(0, dtype=np.uint32)
    for words in _pieces(text):
        if not words:
            continue
        new = np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words))
        yield 1, new
        if most_words == 1:
            continue
        before = len(crcs)
        crcs = np.concatenate([crcs, new])
        lengths = np.concatenate([lengths, np.fromiter(map(len, words), dtype=np.uint32, count=len(words))])
        spaced = lengthened(np.full(len(crcs), crc32(b" "), dtype=np.uint32), lengths) ^ crcs
        runs = crcs
        for k in range(2, most_words + 1):
            if len(crcs) < k:
                break
            runs = lengthened(runs[:-1], lengths[k - 1 :] + np.uint32(1)) ^ spaced[k - 1 :]
            yield k, runs[max(0, before - k + 1) :]
        crcs, lengths = crcs[1 - most_words :], lengths[1 - most_words :]


def bucket_counts(docs: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features of all texts in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros(buckets, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                for _, crcs in feature_crcs(text.as_py() or b"", most_words):
                    waiting.append(crcs)
                    size += len(crcs)
                    if size >= COUNTED:
                        total += np.bincount(np.concatenate(waiting) % np.uint32(buckets), minlength=buckets)
                        waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting) % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = docs.select(text_or_empty().cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths."""
    side = lambda df, k: bucket_counts(df, most_words, buckets).select("bucket", *[(F.col("n") if i == k else F.lit(0)).alias(x) for i, x in enumerate("st")])
    both = side(docs, 0).unionByName(side(target, 1)).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    s, t = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for row in both.collect():  # at most `buckets` rows
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * all_s / ((float(x) + 1) * all_t))) for x, y in zip(s, t)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column(1):
                n, total, words = 0, 0, 0
                for k, crcs in feature_crcs(text.as_py() or b"", most_words):
                    n += len(crcs)
                    total += int(gain[crcs % np.uint32(len(gain))].sum())
                    words += len(crcs) if k == 1 else 0
                n_words.append(words)
                n_features.append(n)
                weight.append(total // n if n else 0)
            arrays = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "weight"])

    texts = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null where a document isn't drawn.

    Of the documents with at least least_words words, floor(percent * N / 100) are drawn.
    """
    gain = gains(docs, target, most_words, buckets)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(uniform))).cast("long")
    scored = weights(docs, gain, most_words).select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("enough"))
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    draw = scored.where("enough").count() * percent // 100
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    rank = F.when(F.col("enough") & (F.col("rank") <= draw), F.col("rank")).alias("rank")
    return numbered(scored, order, "rank").select("doc_id", "n_features", "weight", "score", rank)


def drawn(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", **settings: int) -> DataFrame:
    """The rows of `docs` whose id is drawn, with all their columns; ids should be those of rows."""
    found = resample(docs.withColumn("doc_id", F.col(id_column)), target, **settings).where("rank is not null")
    return docs.join(found.select(F.col("doc_id").alias(id_column)).distinct(), id_column, "left_semi")
