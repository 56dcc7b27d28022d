"""From raw documents to training shards, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stavemill.llm import decontam, minhash, mixing, quality, sharding
from stavemill.llm.common import staged, table

STAGES = [
    ("quality rules", quality.pipeline_stage),
    ("MinHash near-dedup", minhash.pipeline_stage),
    ("benchmark decontamination", decontam.pipeline_stage),
    ("mixing sources to target weights", mixing.pipeline_stage),
    ("sharding", sharding.pipeline_stage),
]

#: Labelling, signatures, Newton steps and flows are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
