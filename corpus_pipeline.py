"""From raw documents to training sequences in five stages.

Each stage takes the documents that its predecessor kept and returns documents
with the same columns; the last returns pieces of packed sequences. Rows that
share both an id and a text, white space aside, count as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from loomgraph.llm.shared import cut, row_key


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not call toxic, in their columns as they were."""
    network = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, network, score_col="_score").where(F.col("_score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    found = cut(exact_dedup.dedup(docs).select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"), "kept"))
    plain = F.translate(F.coalesce(F.col("text"), F.lit("")), "\t\n\x0b\x0c\r ", "")
    rows = docs.withColumn("_own", F.unhex(F.sha2(plain, 256)))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha"))
    left = rows.join(found.where("kept").drop("kept"), same, "left_semi")
    # Only where rows repeat their id with their text do several answer to the one that stays.
    if found.groupBy("_id", "_sha").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", "_own"])
    return left.select(*docs.columns)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id, nulls last."""
    found = cut(ngram_join.ngram_join(docs, keyed=True).select(F.col("row").alias("_key"), "kept"))
    left = docs.withColumn("_row", row_key(docs)).join(found.where("not kept"), F.col("_row") == F.col("_key"), "left_anti")
    # Only where rows repeat in full are several marked as the one that stays.
    if found.where("kept").groupBy("_key").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates(["_row"])
    return left.select(*docs.columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs, mixing.mix(docs))


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the network nor the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
