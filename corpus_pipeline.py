"""A training corpus from raw documents, in five stages of the training-data operators.

1. quality rules: documents that the base rules or the classifier reject go;
2. line dedup: boilerplate lines of a source go from its documents;
3. near-dedup: one document of each group of near copies stays;
4. mixing: words are drawn from the sources by weight, a row for each document and pass;
5. packing: what was drawn is packed into sequences of related documents.

Each stage gets what the one before it wrote.  All but the last return the columns of
``documents``.  The stages learn and count over their own input alone (and ``labels``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subtide.llm import bagminhash, common, line_dedup, mixing, packing, quality_rules

#: Blocks of the mix are long here, so that most documents are drawn whole.
MIX_BLOCK = 1024
#: A line goes from a source when more than this share of its documents have it, and so many at least (a
#: source has far more rows than a site, which share far fewer lines; some copies of one document are left to stage 3).
LINE_RATIO, LINE_ROWS = 0.01, 10


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return quality_rules.keep(docs, quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_documents(docs, LINE_RATIO, LINE_ROWS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return bagminhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, block=MIX_BLOCK)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Classifier, signatures and permutations have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
