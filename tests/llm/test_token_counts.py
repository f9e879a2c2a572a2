from collections import Counter

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidentia.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE, COUNTER = Tokenizer.from_file(PATH), token_counts.library_counter(PATH)


def test_counts_of_whole_texts(edge_docs, edge_rows):
    rows = token_counts.token_counts(edge_docs, PATH).collect()
    expected = Counter()
    for doc_id, text, *_ in edge_rows:
        n = len(WHOLE.encode(text, add_special_tokens=False).ids)
        expected[doc_id, len(text.encode()), n, n > 2048] += 1
    assert Counter(map(tuple, rows)) == expected


def test_empty_table(no_docs):
    assert token_counts.token_counts(no_docs, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1'sSt\n\t\r  .你\U0001f600İß́<|>endoftx"), max_size=60))
def test_parts_count_as_the_whole(text):
    assert COUNTER.count([text]) == [len(WHOLE.encode(text, add_special_tokens=False).ids)]


def test_memo_is_bounded():
    counter = token_counts.PartCounter(lambda parts: [[0]] * len(parts), room=10)
    for at in range(0, 100, 5):
        counter.count([" ".join(map(str, range(at, at + 5)))])
        assert len(counter.known) <= 16
