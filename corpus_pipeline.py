"""A training corpus from ``documents``: each stage reads what its predecessor wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``, also ones with odd or clashing names.

Defined cases: a null or empty text isn't toxic, has no near copies, isn't
contaminated, holds no personal data, and is packed as its end token alone. Of
rows that share a doc_id, near copies of another document all go, since a
document goes as a whole; toxicity and contamination are judged row by row. A
null doc_id comes before all others, so the near-copy stage keeps it. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from focusloom.llm import decontamination, near_dedup, packing, pii, toxicity
from focusloom.llm.common import discard, shared_dir


#: Texts are near copies of each other from this similarity on, in hundredths.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = docs.select(F.col("doc_id").alias("_id"), *(F.col(f"`{c}`").alias(n) for n, c in zip(names, docs.columns)))
    kept = toxicity.scored(whole, model, "_id", tuple(names), names[docs.columns.index("text")]).where("score < 0.5")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    gone = near_dedup.near_duplicates(docs, NEAR).where("not kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty lies in benchmark windows."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by surrogates; n_chars follows the text."""
    out = pii.pseudonymize(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: Scores, surrogates and tokens aren't to be had in SQL; the stages are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        before = docs if k else None
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if before is not None:
            discard(before)
    return docs
