import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import bpe_tree

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe_tree.read_ranks(PATH)
WHOLE = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe_tree.TreeCodec(RANKS, PATTERN)


def test_ids_and_round_trip(edge_docs, edge_rows):
    rows = bpe_tree.encode_decode(edge_docs, PATH, PATTERN).collect()
    expected = Counter()
    for doc_id, text, *_ in edge_rows:
        ids = WHOLE.encode_ordinary(text)
        expected[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", " ", "  ", "\n", "the", "1", "23", "'s", ".", "!?", "你", "\U0001f600", "\t", "zq" * 9]), max_size=120), st.integers(2, 40), st.integers(2, 24))
def test_small_leaves_give_the_same_ids(parts, leaf_chars, leaf_bytes):
    text, kept = "".join(parts), (bpe_tree.LEAF_CHARS, bpe_tree.LEAF_BYTES, bpe_tree.WINDOW_TOKENS, bpe_tree.LONG_RUN)
    try:
        import re

        bpe_tree.LEAF_CHARS, bpe_tree.LEAF_BYTES, bpe_tree.WINDOW_TOKENS = leaf_chars, leaf_bytes, 2
        bpe_tree.LONG_RUN = re.compile(r"\S{8,}|\s{8,}")
        ids = CODEC.encode(text)
        assert ids == WHOLE.encode_ordinary(text)
        assert CODEC.decode(ids) == text.encode()
    finally:
        bpe_tree.LEAF_CHARS, bpe_tree.LEAF_BYTES, bpe_tree.WINDOW_TOKENS, bpe_tree.LONG_RUN = kept


def test_long_matches():
    for text in ("x" * 50_000, "ab" * 20_000, "naïve" * 5000, " " * 9000 + "x", "1" * 7000, "!?" * 4000, "a b " * 9000):
        assert CODEC.encode(text) == WHOLE.encode_ordinary(text)


def test_empty_table(no_docs):
    assert bpe_tree.encode_decode(no_docs, PATH, PATTERN).count() == 0
