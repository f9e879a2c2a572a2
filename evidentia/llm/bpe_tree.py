"""Byte-level BPE encoding and decoding by tree reduction.

A text is halved until its parts are short; parts are encoded by the library, and neighbours are joined up the tree by
encoding a window around their boundary again. Encoding with joins is a monoid, and two facts tell when the tokens
outside the window are final:

- The pattern looks at what follows a match at most, never at what precedes it, and a single space between other
  characters always starts a match. So what stands beyond such a space on either side isn't changed by the join; the window
  grows until it has one on each side (or an end of the text).
- Within one long match: a sequence of tokens is the encoding of its bytes if each pair of neighbours is the encoding
  of its own bytes. So the window grows until its first and last tokens agree with those next to it.

Decoding concatenates the bytes of the two halves of the ids up the same kind of tree.

Rows: one per input row; null text counts as empty (no ids). Repeated rows are encoded each, other columns are ignored,
null doc_ids stay. Empty tables give empty results. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evidentia.llm.common import text_or_empty

#: Characters of a text's leaf, bytes of a match's leaf, and the first window on each side.
LEAF_CHARS, LEAF_BYTES, WINDOW_CHARS, WINDOW_TOKENS = 2048, 512, 64, 8
#: Ids of a leaf in decoding.
LEAF_IDS = 4096
#: Two spaces of this kind never belong to one match: single, between characters that aren't white space.
TIGHT_SPACE = re.compile(r"(?<=\S) (?=\S)")
LONG_RUN = re.compile(rf"\S{{{LEAF_CHARS // 2},}}|\s{{{LEAF_CHARS // 2},}}")


class TreeCodec:
    """Encoder and decoder over the ranks of a byte-level BPE and the pattern that splits texts before it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    # one match ------------------------------------------------------------------------------------------------------

    def _leaf(self, piece: bytes) -> list[int]:
        return self.encoding._encode_single_piece(piece)

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            found = self.pairs[left, right] = self._leaf(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def _join_match(self, left: list[int], right: list[int]) -> list[int]:
        window = WINDOW_TOKENS
        while True:
            head, tail = max(0, len(left) - window), min(len(right), window)
            data = b"".join(map(self.bytes_of.__getitem__, [*left[head:], *right[:tail]]))
            middle = self._leaf(data)
            if (head == 0 or self._fit(left[head - 1], middle[0])) and (tail == len(right) or self._fit(middle[-1], right[tail])):
                return [*left[:head], *middle, *right[tail:]]
            window *= 2

    def _halved(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self._leaf(data)
        middle = len(data) // 2
        return self._join_match(self._halved(data[:middle]), self._halved(data[middle:]))

    # texts ----------------------------------------------------------------------------------------------------------

    def _encode_plain(self, text: str) -> list[int]:
        if LONG_RUN.search(text) is None:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for match in self.matches.finditer(text):
            ids += self._halved(match[0].encode())
        return ids

    @staticmethod
    def _cut_before(text: str, end: int) -> int:
        """The last tight space at or before `end`, looking back in growing steps; else 0."""
        window = WINDOW_CHARS
        while True:
            low = max(0, end - window)
            found = None
            for found in TIGHT_SPACE.finditer(text, low, end):
                pass
            if found is not None or low == 0:
                return found.start() if found is not None else 0
            window *= 2

    @staticmethod
    def _cut_after(text: str, start: int) -> int:
        found = TIGHT_SPACE.search(text, start)
        return found.start() if found is not None else len(text)

    def _reduce(self, text: str, low: int, high: int) -> list[int]:
        """The encoding of text[low:high] taken as a text of its own."""
        if high - low <= LEAF_CHARS:
            return self._encode_plain(text[low:high])
        middle = (low + high) // 2
        left, right = self._reduce(text, low, middle), self._reduce(text, middle, high)
        return self._join(text[low:middle], text[middle:high], left, right)

    def _join(self, before: str, after: str, left: list[int], right: list[int]) -> list[int]:
        head, tail = self._cut_before(before, len(before)), self._cut_after(after, 0)
        n_left = len(self._encode_plain(before[head:])) if head else len(left)
        n_right = len(self._encode_plain(after[:tail])) if tail < len(after) else len(right)
        middle = self._encode_plain(before[head:] + after[:tail])
        return [*left[: len(left) - n_left], *middle, *right[n_right:]]

    def encode(self, text: str) -> list[int]:
        return self._reduce(text, 0, len(text)) if text else []

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text of `docs`."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(read_ranks(ranks_path), pattern)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
