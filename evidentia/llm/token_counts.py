"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at safe boundaries (spaces and line feeds): the vocabulary's pre-tokenizer drops white space and no
token, normalisation rule or special string crosses it, so the counts of the parts add up to the count of the text.
Parts met before are counted from a bounded memo; new parts go to the library in batches of about equal bytes.

Rows: one per input row. Null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows are
counted each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evidentia.llm.common import text_or_empty

#: Bytes of text in one call of the library.
BATCH_BYTES = 256 << 10
#: Parts kept in a worker's memo, and the longest part that is kept.
MEMO_PARTS, MEMO_CHARS = 600_000, 64


class PartCounter:
    """Token counts of parts, asked from `encode_batch` once and remembered while there is room."""

    def __init__(self, encode_batch: Callable[[list[str]], list], room: int = MEMO_PARTS):
        self.encode_batch, self.room, self.known = encode_batch, room, {"": 0}

    def learn(self, parts: set[str]) -> None:
        batch, size = [], 0
        for part in parts:
            batch.append(part)
            size += len(part.encode())
            if size >= BATCH_BYTES:
                self.known.update(zip(batch, map(len, self.encode_batch(batch))))
                batch, size = [], 0
        if batch:
            self.known.update(zip(batch, map(len, self.encode_batch(batch))))

    def count(self, texts: list[str]) -> list[int]:
        split = [text.replace("\n", " ").split(" ") for text in texts]
        known = self.known
        new = {part for parts in split for part in parts if part not in known}
        self.learn(new)
        counts = [sum(map(known.__getitem__, parts)) for parts in split]
        if len(known) > self.room:
            self.known = {"": 0}
        else:
            for part in new:
                if len(part) > MEMO_CHARS:
                    del known[part]
        return counts


def library_counter(path: str) -> PartCounter:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return PartCounter(lambda parts: tokenizer.encode_batch_fast(parts, add_special_tokens=False))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) of every text of `docs`."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = library_counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            n = counter.count(texts.to_pylist())
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(count, schema)
