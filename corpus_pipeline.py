"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `docs`. Rows without a doc_id are filtered like others, by their texts; rows without a text pass every filter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.decontamination import contaminated
from quarrystone.llm.near_duplicates import near_duplicates
from quarrystone.llm.packing import pack_documents
from quarrystone.llm.toxicity import ToxicityModel
from quarrystone.llm.work import Work

#: Shorter benchmark items are words that clean documents hold by chance.
LEAST_TOKENS = 8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model trained on the labelled rows of the corpus calls toxic go."""
    model = ToxicityModel.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies (five-word shingles, similarity 0.8) stays: that of the smallest doc_id.

    Texts that share a doc_id, or have none, are documents of their own, the latter after all others; of rows that repeat doc_id and text, one stays.
    """
    # Repeated and missing ids are looked for among the ids only.
    repeats = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").limit(1).count()
    if not repeats:
        gone = near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id").distinct()
        return docs.join(gone, docs.doc_id.cast("long") == gone.doc_id, "left_anti")
    # Numbers in order of doc_id, one for each of its texts. A table, so that they stay as they are.
    own, digest = docs.doc_id.cast("long"), F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))
    pairs = docs.select(own.alias("id"), digest.alias("digest")).distinct().orderBy(F.asc_nulls_last("id"), "digest")
    pairs = Work(spark, "near-dedup").put(pairs.withColumn("number", F.monotonically_increasing_id()), "numbers")
    rows = docs.select(own.alias("own"), digest.alias("its"), "text")
    numbered = rows.join(pairs, F.col("own").eqNullSafe(F.col("id")) & (F.col("its") == F.col("digest"))).select(F.col("number").alias("doc_id"), "text")
    gone = near_duplicates(numbered, shingle=5, percent=80).where("not kept").select(F.col("doc_id").alias("number")).distinct()
    gone = pairs.join(gone, "number").select("id", "digest")
    return docs.join(gone, own.eqNullSafe(gone.id) & (digest == gone.digest), "left_anti").dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage of LEAST_TOKENS tokens or more, word for word or with some words replaced, go."""
    # Texts that share a doc_id, or have none, are told apart.
    key = F.xxhash64(docs.doc_id.cast("long"), docs.text)
    found = contaminated(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True, least_tokens=LEAST_TOKENS).select("doc_id").distinct()
    found = Work(spark, "pipeline").put(found, "contaminated")
    return docs.join(found, key == found.doc_id, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of at most 1024 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Training, similarity classes and best-fit packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    work = Work(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = work.put(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
