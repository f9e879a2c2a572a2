"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Tokenizing: where a tokenizer is plain byte-level BPE, its own vocabulary goes to an encoder over ranks, which gives the same ids
of texts in common scripts several times faster; all other texts, and other tokenizers, go to the tokenizer itself. There a text
is split before single spaces that stand between other characters, where the byte-level pre-tokenizer always starts a
token, and the ids of parts met before come from a bounded memo. Only the placing data of the pieces is shuffled (about 40
bytes each), by a hash, so partitions are even whatever the documents' sizes or sources.

Packing: bounded-space online best-fit within a partition. A bitset over free space tells the tightest open bin that
takes a piece; when more than OPEN_BINS are open, the fullest closes. Pieces come in the order of a hash of their place, so
a repeated task makes the same bins, and the longest of each Arrow batch first. Each partition leaves at most OPEN_BINS bins partly filled.

Rows: one per piece; a null text counts as empty and gives one piece with the end token. Rows of equal content, null
doc_ids and repeated rows are packed each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import text_or_empty

CAPACITY, END_ID, OPEN_BINS = 1024, 2, 8192
MEMO_PARTS, MEMO_CHARS, BATCH_PARTS = 400_000, 64, 4096
#: A space next to white space: there the pre-tokenizer may cut elsewhere.
LOOSE = re.compile(r" \s|\s ")
TIGHT_SPACE = re.compile(r"(?<=\S) (?=\S)")


def parts_of(text: str) -> list[str]:
    """The text in parts that are tokenized each on its own; all but the first come without their leading space."""
    return text.split(" ") if LOOSE.search(text) is None else TIGHT_SPACE.split(text)


class PartEncoder:
    """Ids of texts, as little-endian unsigned 32-bit integers; `encode_batch` turns strings into lists of ids."""

    def __init__(self, encode_batch: Callable[[list[str]], list[list[int]]], room: int = MEMO_PARTS):
        self.encode_batch, self.room = encode_batch, room
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _learn(self, known: dict[str, bytes], new: set[str], lead: str) -> None:
        new = list(new)
        for at in range(0, len(new), BATCH_PARTS):
            some = new[at : at + BATCH_PARTS]
            for part, ids in zip(some, self.encode_batch([lead + part for part in some])):
                known[part] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [parts_of(text) for text in texts]
        first, later = self.first, self.later
        new_first = {parts[0] for parts in split if parts[0] not in first}
        new_later = {part for parts in split for part in parts[1:] if part not in later}
        self._learn(first, new_first, "")
        self._learn(later, new_later, " ")
        encoded = [b"".join([first[parts[0]], *map(later.__getitem__, parts[1:])]) for parts in split]
        if len(first) + len(later) > self.room:
            self.first, self.later = {}, {}
        else:
            for known, new in ((first, new_first), (later, new_later)):
                for part in new:
                    if len(part) > MEMO_CHARS:
                        del known[part]
        return encoded


#: Fixed value: the pattern that splits texts in byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes (letter, number, space) no version of Unicode disputes; and runs that only trees take well.
COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa0-\u0233\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u2013-\u2026\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\U0001f600-\U0001f64f]*")
LONG_RUN = re.compile(r"\S{400}|\s{400}")


def byte_level_ranks(path: str) -> tuple[dict[bytes, int], list[str]] | None:
    """Ranks and added tokens of a tokenizer file if it is plain byte-level BPE whose ids follow its merges; else None."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    model, before = held["model"], held.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not held.get("normalizer")
    plain = plain and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain:
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))) or {vocab.get(c) for c in byte_of} != set(range(256)):
        return None
    ranks = {bytes(map(byte_of.__getitem__, token)): vocab[token] for token in [*byte_of, *merged]}
    return ranks, [token["content"] for token in held.get("added_tokens", [])]


class RankEncoder:
    """Ids of texts by ranks where that is sure to give the tokenizer's ids, and by `other` elsewhere."""

    def __init__(self, ranks: dict[bytes, int], added: list[str], other: PartEncoder):
        import tiktoken

        self.encode_ordinary = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.other = other

    def sure(self, text: str) -> bool:
        return COMMON.fullmatch(text) is not None and LONG_RUN.search(text) is None and (self.added is None or self.added.search(text) is None)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.encode_ordinary(text)).tobytes() if self.sure(text) else self.other.encode([text])[0] for text in texts]


def text_encoder(path: str) -> RankEncoder | PartEncoder:
    other, found = library_encoder(path), byte_level_ranks(path)
    return RankEncoder(*found, other) if found and sys.byteorder == "little" and array("I").itemsize == 4 else other


def library_encoder(path: str) -> PartEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return PartEncoder(lambda parts: [e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every text with its end token.

    Texts beyond the capacity are cut into full pieces; what is left over comes first.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path)
        for batch in batches:
            own, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n % capacity or capacity) if at == 0 else capacity
                    own.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            columns = [batch.column(0).take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return rows.mapInArrow(cut, schema)


class BestFit:
    """Bins of a capacity, at most `open_bins` of them open; place() gives a bin's number and the place in it."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self.bins[space].pop()
            if not self.bins[space]:
                self.free ^= 1 << space
            self.n_open -= 1
        else:
            space, number = self.capacity, self.n_bins
            self.n_bins += 1
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:
                tightest = (self.free & -self.free).bit_length() - 1
                self.bins[tightest].pop()
                if not self.bins[tightest]:
                    self.free ^= 1 << tightest
                self.n_open -= 1
        return number, self.capacity - space


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """`pieces` with sequence_id and offset. Lengths are from 1 to the capacity."""
    # the row's number in its task is hashed too, so that rows without a doc_id and repeated rows spread like others
    row = "_row"
    order = F.xxhash64("doc_id", "piece", "ids_crc32", row)
    held = pieces.withColumn(row, F.monotonically_increasing_id()).repartition(order).sortWithinPartitions(order, "doc_id", "piece", "ids_crc32").drop(row)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = pieces.columns.index("length")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        packer = BestFit(capacity, open_bins)
        for batch in batches:
            lengths = batch.column(at).to_numpy()
            long_first = np.argsort(-lengths, kind="stable")
            placed = np.array([packer.place(length) for length in lengths[long_first].tolist()], dtype=np.int64).reshape(-1, 2)
            placed[long_first] = placed.copy()
            columns = [*batch.columns, pa.array(base + placed[:, 0]), pa.array(placed[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return held.mapInArrow(fill, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """The pieces of every text of `docs` with the sequence and the place where each was packed."""
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity, open_bins)
