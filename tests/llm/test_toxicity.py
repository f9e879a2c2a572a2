import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import toxicity


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_one_row_each(edge_docs, edge_rows, labels):
    rows = toxicity.toxicity(edge_docs, labels).collect()
    assert Counter((r.doc_id, r.held_out) for r in rows) == Counter((d, held(d)) for d, *_ in edge_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_accuracy(spark):
    """Measured on documents whose labels were never used."""
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    labelled = docs.join(labels, "doc_id", "left_semi")
    scored = toxicity.toxicity(labelled, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in scored) / len(scored)
    caught = [r.predicted for r in scored if r.toxic]
    false = [r.predicted for r in scored if not r.toxic]
    assert right >= 0.97 and sum(caught) / len(caught) >= 0.9 and sum(false) / len(false) <= 0.02


def test_kernel_tolerates_gaps_and_inserted_letters():
    sub = toxicity.subsequences
    same = toxicity.kernel(sub("stupid"), sub("stupid"))
    assert same == pytest.approx(1.0)
    assert toxicity.kernel(sub("stupid"), sub("stuxpid")) > 0.4 > toxicity.kernel(sub("stupid"), sub("garden"))


def test_altered_insults_in_held_out_texts(spark):
    """Held-out toxic documents whose telling words are altered; the clean ones stay as they are."""
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    machine = toxicity.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where(toxicity._fold(F.col("doc_id")) == 1).select("text", "toxic").collect()
    toxic, clean = [r.text for r in rows if r.toxic], [r.text for r in rows if not r.toxic]

    def change(text, how):
        words = sorted({w for w in re.findall(r"\w+", text.lower()) if 4 <= len(w) <= 24})
        bad = {w for w, m in zip(words, machine.margins(words)) if m > 0.2}
        return re.sub(r"\w+", lambda x: how(x[0]) if x[0].lower() in bad else x[0], text)

    ways = {"inserted": lambda w: w[:2] + "x" + w[2:], "dots": ".".join, "spaces": " ".join, "a space": lambda w: w[:2] + " " + w[2:]}
    for name, how in ways.items():
        assert np.mean(machine.scores([change(x, how) for x in toxic]) >= 0.7) >= 0.8, name
    assert np.mean(machine.scores([change(x, lambda w: w[:2] + w[3:]) for x in toxic]) >= 0.7) >= 0.7
    assert np.mean(machine.scores(clean) >= 0.7) <= 0.02
    assert all(slope >= 0 for slope in machine.curve[:-1])


def test_folded_margins_are_sums_of_kernels_over_landmarks():
    landmarks, toxic, clean = ["stupid", "garden", "hello", "stup"], ["stupid", "stuxpid", "stu pid"], ["garden", "the garden", "hello", "of"]
    machine, weights = toxicity.fit_machine(landmarks, toxic, clean)
    sub = toxicity.subsequences
    words = [*toxic, *clean, "a", "stupidly", "other 你好", "x" * toxicity.WINDOW]
    plain = [machine.bias + sum(v * toxicity.kernel(sub(x), sub(w)) for x, v in zip(landmarks, weights)) for w in words]
    assert machine.margins(words) == pytest.approx(plain, abs=1e-4)
    assert machine.word_margins(words + words) == pytest.approx(plain + plain, abs=1e-4)
    assert min(plain[:3]) > max(plain[3:7])


def test_many_letters_share_numbers_and_drop_nothing():
    letters = [chr(0x4E00 + k) for k in range(3 * toxicity.MOST_LETTERS)]
    machine = toxicity.Machine({x * 3: 1.0 for x in letters}, 0.0)
    assert all(machine.table[sum(int(machine.number[ord(x)]) * machine.size**k for k in range(3))] >= 1 for x in letters)


def test_altered_words():
    word = "stupid"
    assert [len(toxicity.altered(word, kind)) for kind in range(toxicity.KINDS)] == [7, 7, 7, 7, 5, 6, 8, 7]
    assert all(toxicity.altered(word, kind) == toxicity.altered(word, kind) != word for kind in range(4)) and toxicity.altered("abc", 0) == "abc"


def test_labels_of_one_kind(edge_docs, edge_rows, labels):
    rows = toxicity.toxicity(edge_docs, labels.where("toxic = 0")).collect()
    assert len(rows) == len(edge_rows) and {r.score for r in rows} == {0.0}


def test_dropping_keeps_columns(edge_docs, edge_rows, labels):
    left = toxicity.drop_toxic(edge_docs, labels)
    assert left.columns == edge_docs.columns
    clean = Counter(r.doc_id for r in toxicity.toxicity(edge_docs, labels).collect() if not r.predicted)
    assert Counter(r.doc_id for r in left.select("doc_id").collect()) == clean


def test_empty_tables(no_docs, labels, edge_docs, edge_rows):
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert toxicity.toxicity(edge_docs, labels.limit(0)).count() == len(edge_rows)
