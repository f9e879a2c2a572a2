"""Documents, stage by stage: quality rules, toxicity, exact dedup, SimHash near-dedup, best-fit packing.

Each stage reads what the one before it wrote, and its decisions take effect: rows that it rejects are gone for the stages after
it. All stages but the last return the columns of `documents`; the last returns the packed pieces. doc_id identifies
a document. SQL can express neither the tokenizer nor the string-kernel machine, so ORACLE_SQL is None and the tests
hold run() against a brute-force version.

Rows: null and empty texts have too few words for the first stage and go there. Long texts are read whole. Ties and repeated rows:
of equal or near-equal texts one row stays, the longest and then the smallest doc_id of equal ones, the smallest doc_id of near ones;
null doc_ids lose to others. Columns beside doc_id, text, lang and source are carried along, whatever their names.
Empty tables give empty results at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import exact_dedup, packing, quality_rules, simhash, toxicity
from evidentia.llm.common import documents
from evidentia.llm.registry import tokenizer_path
from evidentia.storage import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(docs)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs, from_files=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("toxicity", keep_civil),
    ("exact_dedup", keep_one_of_equals),
    ("simhash_near_dedup", keep_one_of_similar),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of `documents`; each stage's result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
