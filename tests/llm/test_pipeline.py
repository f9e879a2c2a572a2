"""The pipeline against its stages by plain means."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import toxicity
from evidentia.storage import materialize
from tests.llm import test_exact_dedup, test_packing, test_quality_rules, test_simhash

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]
    rows = [(r.doc_id, r.text or "", r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = {key[0] for key in test_quality_rules.brute(rows) if key[-1]}
    rows = [r for r in rows if r[0] in kept]
    left = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    civil = {r.doc_id for r in toxicity.toxicity(left, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0").collect()}
    rows = [r for r in rows if r[0] in civil]
    first = {key[0] for key in test_exact_dedup.brute(rows) if key[3]}
    rows = [r for r in rows if r[0] in first]
    single = {d for d, _, c in test_simhash.expected(rows) if d == c}
    rows = [r for r in rows if r[0] in single]
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = test_packing.own_ids(text)
        at = 0
        while at < len(ids):
            size = len(ids) % 1024 if at == 0 and len(ids) % 1024 else 1024
            expected[doc_id, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at += size
    found = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()
    assert Counter(map(tuple, found)) == expected
    # on a table this small some stages find nothing to drop; their effects are tested each on its own
    assert spark.read.parquet(f"{SF}/documents.parquet").count() > len(kept) >= len(civil) >= len(first) >= len(single) > 0
    assert public_tokenizers.path("byte_bpe_50k.json") == test_packing.PATH


def test_every_stage_but_the_last_keeps_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of the documents and labels of sf0.01 with rows planted for each stage, odd rows, and columns that clash."""
    path = f"file://{tmp_path_factory.mktemp('planted')}"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    words = [f"{a}{b}" for a in ("ba", "ko", "mu", "ri", "se", "to") for b in ("lan", "dim", "vor", "sek", "pul", "gan")]
    text = " ".join(words[(7 * k * k + 3 * k) % len(words)] + str(k % 97) for k in range(600))
    rows = [
        (2_000_000, text, "en", "src1"),
        (2_000_001, text.replace(" ", "\n", 5), "en", "src1"),
        (2_000_001, text.replace(" ", "\n", 5), "en", "src1"),
        (2_000_002, text.replace(text.split()[300], "changed", 1), "en", "src1"),
        (2_000_003, "You trash and clown , stupid trash of a clown , all of it is only that , and to be sure .", "en", "src1"),
        (2_000_004, " ".join("one two three four five # * $ % & | < > six".split() * 1), "en", "src1"),
        (2_000_005, None, None, None),
        (None, "", "en", "src1"),
        (2_000_006, " ".join(f"{w[:3]}{k}" for k in range(900) for w in words[:10]), "en", "src1"),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(odd)
    for name in ("own", "rid", "score", "kept", "fp", "a.b"):
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_drops_what_is_planted_for_it(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, planted), name)
        assert docs.columns == columns
        left.append(Counter(r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is None or r.doc_id >= 2_000_000))
    text, near, toxic, long = 2_000_000, 2_000_002, 2_000_003, 2_000_006
    assert left[0] == Counter({text: 1, 2_000_001: 2, near: 1, toxic: 1, long: 1})
    assert left[1] == Counter({text: 1, 2_000_001: 2, near: 1, long: 1})
    assert left[2] == Counter({text: 1, near: 1, long: 1})
    assert left[3] == Counter({text: 1, long: 1})
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, planted)
    assert {r.doc_id for r in pieces.where("doc_id >= 2000000").collect()} == {text, long}


def test_empty_tables(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs_after = stage(spark, docs, planted)
        assert docs_after.count() == 0
