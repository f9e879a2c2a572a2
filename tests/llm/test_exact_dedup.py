import hashlib
import re
from collections import Counter, defaultdict

from evidentia.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for row, (doc_id, text, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), doc_id is None, doc_id or 0, row))
    out = Counter()
    for text, members in groups.items():
        members.sort()
        keep = rows[members[0][3]][0]
        for k, member in enumerate(members):
            out[rows[member[3]][0], keep, len(members), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_groups(edge_docs, edge_rows):
    assert Counter(map(tuple, exact_dedup.exact_groups(edge_docs).collect())) == brute(edge_rows)


def test_many_levels(edge_docs, edge_rows):
    assert Counter(map(tuple, exact_dedup.exact_groups(edge_docs, block_bytes=97).collect())) == brute(edge_rows)


def test_shared_blocks(spark):
    # texts of the same blocks in other orders, prefixes of each other, and odd and even numbers of blocks
    texts = ["aabb", "bbaa", "aabbaa", "aabbaabb", "aabbaabba", "aabbaabbaa", "bbaabbaabb", "aabb", "a a b b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(i, t) for i, t in enumerate(texts)]
    assert Counter(map(tuple, exact_dedup.exact_groups(docs, block_bytes=2).collect())) == brute(rows)


def test_dropping_keeps_columns_and_rows(edge_docs, edge_rows):
    left = exact_dedup.drop_exact_copies(edge_docs)
    assert left.columns == edge_docs.columns
    kept = {key[0] for key in brute(edge_rows) if key[3]}
    assert {r.doc_id for r in left.select("doc_id").collect()} - {None} == kept - {None}


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    # a repeated row that keeps its own group, a keeper with the id of a dropped copy of another text, and copies without an id
    rows = [(1, "a b"), (1, "a b"), (2, "c  d"), (3, "c d"), (3, "e"), (None, "f"), (None, "f"), (None, None), (None, "")]
    left = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter([(1, "a b"), (2, "c  d"), (3, "e"), (None, "f"), (None, "")])


def test_empty_table(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.drop_exact_copies(no_docs).count() == 0
