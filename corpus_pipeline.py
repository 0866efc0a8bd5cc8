"""A corpus pipeline: toxic documents go, copies and near copies go, benchmark passages go, and what is left is mixed.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before has kept and returns a DataFrame with
the columns of documents; the last one returns what the mix takes of each document.

Rows without doc_id, and rows that repeat one, go through all stages as documents of their own; of copies the smallest id
stays, null last. Null and empty texts are not toxic, are copies of each other, have no near copies and no passages, and
mix as 0 words. Empty documents give an empty result; without labels no document is toxic, without benchmark items none is
contaminated. Further columns, whatever their names, are carried along up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import decontaminate, exact_dedup, jaccard_join, mixing, toxicity
from vexel.llm.common import documents, remove, shared_dir


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, under a name that no column has."""
    name, taken = "_row", {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def _without(rows: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    return rows.join(dropped.select(name).hint("shuffle_hash"), name, "left_anti").drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, name = _numbered(docs)
    return _without(rows, exact_dedup.exact_dedup(rows, extra=(name,)).filter(~F.col("kept")), name).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, name = _numbered(docs)
    return _without(rows, jaccard_join.jaccard_join(rows, extra=name).filter(~F.col("first")), name).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: The toxicity model is trained, which SQL cannot express; tests/llm holds run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; of what they write, the last one's table stays, in the shared folder."""
    docs, root = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k:
            remove(spark, f"{root}/{k - 1}")
    return docs
