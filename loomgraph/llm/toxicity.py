"""Toxicity of whole texts by a recurrent network over all overlapping windows.

The network (``gru``) is trained on the driver on a bounded sample of labelled
rows: at most ``per_label`` rows of each label, those with the least digest of
their id. Its parameters, a few megabytes whatever the input, go to the tasks,
which score every window of every text. Nothing but the text is looked at.

Defined results: null and empty texts, and texts without letters or digits,
get the score of no evidence at all; repeated rows get equal scores; an empty
table gives an empty result; without labelled rows of both labels every text
gets the score of the label there is, 0 if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gru import Network, train
from .textvec import portions

PER_LABEL = 1500
STEPS = 300
THRESHOLD = 0.5


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from; ids that are null are among them."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, per_label: int, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``per_label`` rows of each label."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col(label_col).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_y"))
    chosen = None
    for k in (0, 1):
        part = usable.where(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * per_label ids are broadcast.
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    found = rows.select("_id", "_y", "_text").orderBy(F.xxhash64("_id"), "_id", "_text").limit(2 * per_label).collect()
    return [r._text for r in found], np.array([r._y for r in found], np.int64)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    texts, y = sample(docs, labels, per_label, id_col, text_col, label_col)
    return train(texts, y, steps=steps)


def score(docs: DataFrame, network: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != score_col]
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            scores = [net.scores(texts[a:b]) for a, b in portions(texts, 1 << 19)]
            values = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], values], [*kept, score_col])

    return rows.mapInArrow(run, rows.drop("_text").withColumn(score_col, F.lit(0.0)).schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", F.col("text").alias("_body")), network, "_body")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
