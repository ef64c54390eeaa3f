"""Corpus preparation in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame; ``run`` writes every result as Parquet under the shared
checkpoint folder and reads it back for the next stage.

toxicity           documents scored toxic are dropped
line_dedup         repeated lines stay only in their first document (``n_chars`` follows)
near_dedup         one row of each doc_id, then one document of each near-duplicate group stays
decontamination    documents contaminated by ``benchmark`` are dropped
packing            what is left becomes training sequences, one row per piece

The first four return the columns of ``documents``, extra columns unchanged
(whatever their names). Null or empty texts pass every filter; without toxic and
other labels to learn from, the first stage drops nothing; an empty table gives an
empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_risk.llm import common as C
from cohort_risk.llm import decontamination as DC
from cohort_risk.llm import line_dedup as LD
from cohort_risk.llm import minhash_dedup as MD
from cohort_risk.llm import packing as PK
from cohort_risk.llm import queries as Q
from cohort_risk.llm import toxicity as TX

TOXIC_AT = 0.5


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with all columns but id and text under names no operator uses,
    and the expressions that bring the columns of ``docs`` back."""
    names = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    apart = docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns])
    return apart, [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apart, back = _apart(docs)
    model = TX.fit(apart, Q.learned_labels(spark, sf_dir))
    if "constant" in model:  # nothing tells documents apart
        return docs
    return TX.score(apart, model).filter(F.col("score") < TOXIC_AT).select(*back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apart, back = _apart(docs)
    kept = LD.line_dedup(apart)
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        at = docs.columns.index("n_chars")
        back[at] = F.coalesce(length, F.col(f"__own{at}")).alias("n_chars")
    return kept.select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apart, back = _apart(docs)
    return MD.near_duplicates(MD.one_row_per_id(apart)).filter("kept").select(*back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apart, back = _apart(docs)
    return DC.decontaminate(apart, C.table(spark, sf_dir, "benchmark")).select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return PK.pack(docs, Q.BYTE_BPE, Q.BYTE_END)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Toxicity scores, sampling and tokenizers have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
