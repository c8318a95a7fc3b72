"""The corpus pipeline: five stages from raw documents to the mix that a model is trained on.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of documents; the last returns the mix: one row a document with how much of it the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm import decontam, linededup, mixing, ngramjoin, quality
from weftlog.llm.base import settle, table

#: Score from which a document is kept by the quality stage.
KEEP_FROM = 0.5
#: Ids of near duplicates up to which they are broadcast (16 MB), beyond which they are joined by a shuffle.
FEW_IDS = 1_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from three quarters of the labels, as op7 does."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
    return quality.score_quality(docs, model).where(F.col("score") >= KEEP_FROM).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that stand elsewhere before; those of which nothing is left go."""
    left = linededup.dedup_lines(docs).where(~F.col("emptied"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near duplicates. Ids are taken to be unique: repeated rows of
    one id stay together, in line dedup too, and rows with a null id stay."""
    groups = ngramjoin.jaccard_components(docs)
    others = settle(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_other")).distinct(), "others")
    few = others.count() <= FEW_IDS
    return docs.join(F.broadcast(others) if few else others, docs["doc_id"] == others["_other"], "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontam.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: Neither the classifier nor content-defined chunks can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, f"stage{k}")
    return docs
