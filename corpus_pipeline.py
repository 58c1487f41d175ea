"""A training-data pipeline over the table ``documents``: five stages, each written as Parquet and read again as the next one's input.

Toxic documents go; one document of each group of near duplicates stays; passages that repeat are cut out; documents that hold
benchmark items go; the rest is mixed to target weights. All but the last stage return the columns of ``documents``.

Nulls, ties, repeats and clashes, in every stage: a null or blank text is not toxic, in no group of copies, has nothing to cut and holds no item, so its row stays. Rows with equal
ids or null ids are documents by themselves; of a group of near copies the one with the smallest id stays, known ids before null ones, and of equal
ids one. Columns beyond those of ``documents`` are kept, whatever their names; labels for no document count for nothing. An empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontaminate, jaccard, mixture, suffixes, toxicity
from recollect.llm.common import SHINGLE_WORDS, discard, fresh, held_out, scratch
from recollect.session import ship

#: The stages train a model, take hashes and cut bytes, which SQL cannot express; they are tested against brute force instead.
ORACLE_SQL = None
#: The similarity of near copies, in percent, as ``common.SIMILARITY``.
NEAR_PERCENT = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold. The model learns from the labelled documents that the test of the operator does not hold out."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    score = fresh(docs, "score")
    scored = toxicity.scored(docs, model, score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 80 percent of their five-word shingles; op4's own three words and 90 percent are not the stage's."""
    ship(spark)
    return jaccard.one_of_each(docs, SHINGLE_WORDS, NEAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffixes.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixture.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage has written goes when its result is there
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
