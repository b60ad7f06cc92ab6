"""Cleaning pipeline over documents: language, repeated lines, near duplicates, benchmark passages, tokens.

Each stage works on all rows that the one before kept. Null texts and repeated rows are treated as the operators say; an
empty table passes through all stages. Columns beyond those of documents travel along, except through the last stage.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm import bpe, decontamination, jaccard_join, language_id, line_dedup
from sensorlake.llm.common import hash_mod, small_batches
from sensorlake.storage import materialize

#: the tokens of the last stage are in no SQL; tests compare the stages with brute force
ORACLE_SQL = None


def _unused(docs: DataFrame, name: str) -> str:
    """The name, longer if a column has it already."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null, empty or without a letter, whether or not there is a lang to learn from."""
    small_batches(spark)
    model = language_id.train(docs, hash_mod("doc_id", 3) != 1)
    found = _unused(docs, "_language")
    return language_id.identify(docs, model, into=found).where(F.col(f"{found}.letter")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three documents share, except where the largest doc_id holds them; text and n_chars change."""
    small_batches(spark)
    found = _unused(docs, "_lines")
    made = line_dedup.drop_repeated_lines(docs, into=found)
    changed = {"text": F.col(f"{found}.kept"), "n_chars": F.length(f"{found}.kept").cast("long")}
    return made.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates one row, of the smallest doc_id; rows that only share an id all stay."""
    small_batches(spark)
    return jaccard_join.first_of_groups(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = _unused(docs, "_found")
    made = decontamination.contamination(docs, items, into=found)
    return made.where(~F.col(f"{found}.contaminated")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of what they decode to."""
    small_batches(spark)
    return bpe.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
          ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
