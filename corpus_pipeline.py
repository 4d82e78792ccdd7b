"""A cleaning pipeline over `documents`: language ID, near-dedup, benchmark decontamination, PII surrogates, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its rows are written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. run() deletes a stage's rows once the next one's are written. No stage can be written in SQL on
whole tables (the first is a learned model), so ORACLE_SQL is None and tests compare with brute force.

Odd rows: null and wordless texts go in the first stage; rows that share a doc_id are judged together by the stages that drop documents, and
stay or go together (equal rows too: they are one document, repeated); rows without doc_id are kept by these; packing takes each row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veranda.llm import decontaminate, langid, near_dedup, packing, pii
from veranda.llm.common import checkpoint_dir, table
from veranda.llm.queries import piece_digests, pii_key, tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose words have a largest probability of a language under 0.5 in the mean, go; mixed ones stay."""
    return langid.keep_identified(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id."""
    return near_dedup.near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in texts are replaced; n_chars follows the text."""
    out = pii.replace_entities(docs, pii_key(spark), report=False)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_digests(packing.pack(docs, tokenizer("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("sequence_packing", sequence_packing),
]
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _delete(spark, last)
        last = path
    return docs
