import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidentia.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


WHOLE = Tokenizer.from_file(PATH)
BY_PARTS, BY_RANKS = packing.library_encoder(PATH), packing.text_encoder(PATH)


def own_ids(text):
    return [*WHOLE.encode(text, add_special_tokens=False).ids, 2]


def test_pieces_and_places(edge_docs, edge_rows):
    rows = packing.pack_documents(edge_docs, PATH).collect()
    expected = Counter()
    for doc_id, text, *_ in edge_rows:
        ids = own_ids(text)
        at, k = 0, 0
        while at < len(ids):
            size = len(ids) % 1024 if at == 0 and len(ids) % 1024 else 1024
            expected[doc_id, k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at, k = at + size, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r.length for r in rows)
    # each of the tasks leaves bins partly filled at the end; beyond those the sequences are nearly full
    assert len(by_sequence) <= total / 1024 * 1.02 + 16


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 9))
def test_best_fit_chooses_the_tightest_open_bin(lengths, open_bins):
    packer, free, closed = packing.BestFit(64, open_bins), {}, set()
    for length in lengths:
        fitting = sorted(space for space in free.values() if space >= length)
        number, offset = packer.place(length)
        assert number not in closed
        if fitting:
            assert free[number] == fitting[0]
        else:
            assert number not in free
            free[number] = 64
        assert offset == 64 - free[number]
        free[number] -= length
        if free[number] == 0:
            del free[number]
            closed.add(number)
        elif len(free) > open_bins:
            # the fullest closes; which of equally full ones doesn't matter for what follows
            tightest = min(free.values())
            gone = [n for n, space in free.items() if space == tightest and n not in {x for own in packer.bins for x in own}]
            assert len(gone) == 1
            closed.add(gone[0])
            del free[gone[0]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1'st\n\t  .你\U0001f600"), max_size=60))
def test_parts_encode_as_the_whole(text):
    ids = np.frombuffer(BY_PARTS.encode([text])[0], "<u4").tolist()
    assert ids == own_ids(text)[:-1]


COMMON = st.one_of(st.sampled_from("ab 1'sS.,!?-\n\t\r  \xa0éßñäöüØ€–…жщΩω你好のカ\U0001f600<|>_"), st.characters(max_codepoint=0x4E80, exclude_categories=["Cs"]), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet=COMMON, max_size=60))
def test_ranks_encode_as_the_tokenizer(text):
    assert isinstance(BY_RANKS, packing.RankEncoder)
    assert np.frombuffer(BY_RANKS.encode([text])[0], "<u4").tolist() == own_ids(text)[:-1]
    if not BY_RANKS.added.search(text) and packing.COMMON.fullmatch(text):
        assert BY_RANKS.encode_ordinary(text) == own_ids(text)[:-1]


def test_other_tokenizers_have_no_ranks():
    assert packing.byte_level_ranks(public_tokenizers.path("word_bpe_49k.json")) is None
