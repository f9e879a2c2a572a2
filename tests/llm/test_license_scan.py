import re
from collections import Counter

import pytest

from evidentia.llm import license_scan
from evidentia.llm.registry import ORACLES

EXTRA = [
    (1, "x Licensed under the APACHE License, version 2.0; under the MIT license!", "en", "web"),
    (2, "under the mit license under the mit license under the mit", "en", "web"),
    (3, "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "en", "web"),
    (4, "redistribution and use in any source and binary forms with or without modification are permitted provided that the following conditions hold", "en", "web"),
    (5, "under the license mit", "en", "web"),
    (6, "CC-BY-NC cc by nc, cc by nd", "en", "web"),
    (7, "permission is hereby granted", "en", "web"),
]


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text) if w]


def brute(rows):
    """The contract's base, and the diagonal vote by plain loops."""
    out = Counter()
    for doc_id, text, *_ in rows:
        words = words_of(text)
        places, base, labels, score = [], set(), set(), 0.0
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += found
            if found:
                base.add(label)
                score = 1.0
        labels |= base
        enough = []
        for k, (notice, label) in enumerate(license_scan.NOTICES):
            t = notice.split()
            hits = {}
            for i in range(len(words) - 2):
                for j in range(len(t) - 2):
                    if words[i : i + 3] == t[j : j + 3]:
                        hits.setdefault(i - j, []).append(j)
            span, last = [], None
            spans = []
            for d in sorted(hits):
                if last is not None and d - last > license_scan.MAX_SHIFT:
                    spans.append(span)
                    span = []
                span.append(d)
                last = d
            spans += [span] if span else []
            for s in spans:
                covered = len({j for d in s for j in hits[d]})
                first, end = min(d + min(hits[d]) for d in s), max(d + max(hits[d]) + 3 for d in s)
                if covered / (len(t) - 2) >= license_scan.LEAST_COVER and end - first <= license_scan.MOST_STRETCH * len(t):
                    enough.append((first, end, k, covered, covered / (len(t) - 2), label))
        clusters, reach = [], -1
        for span in sorted(enough):
            if span[0] >= reach:
                clusters.append([])
            clusters[-1].append(span)
            reach = max(reach, span[1])
        for cluster in clusters:
            for span in cluster:
                if span[3] == max(x[3] for x in cluster):
                    labels.add(span[5])
                    score = max(score, span[4])
        out[doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)] += 1
    return out


def found(docs):
    return Counter((*r[:7], round(r.score, 9)) for r in license_scan.license_scan(docs).collect())


def test_documents(edge_docs, edge_rows):
    assert found(edge_docs) == brute(edge_rows)


def test_notices(spark):
    docs = spark.createDataFrame(EXTRA, "doc_id long, text string, lang string, source string")
    assert found(docs) == brute(EXTRA)
    by_id = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert by_id[1].base_labels == "apache-2,mit" and by_id[3].labels == "cc-by-nc" and by_id[4].labels == "bsd"
    assert by_id[2].n_base == 2 and by_id[5].labels == "" and by_id[7].labels == ""


def test_empty_table(no_docs):
    assert license_scan.license_scan(no_docs).count() == 0


def test_oracle_is_registered():
    assert "op10_license_scan" in ORACLES


def test_own_templates_and_identifiers(spark):
    texts = [(1, "SPDX-License-Identifier: MPL-2.0"), (2, "SPDX-License-Identifier: unknown"), (3, "the house rules of this site hold for all its visitors at all times"), (4, "The house rules of this very site hold for all visitors")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.license_scan(docs).collect()} == {1: "mpl-2", 2: "", 3: "", 4: ""}
    own = [("the house rules of this site hold for all its visitors", "house")]
    assert {r.doc_id: r.labels for r in license_scan.license_scan(docs.where("doc_id = 3"), [], own).collect()} == {3: "house"}
    with pytest.raises(ValueError):
        license_scan.license_scan(docs, [], [("a " * license_scan.MOST_TEMPLATE_WORDS + "b c d", "x")])
