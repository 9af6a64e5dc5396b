"""From raw documents to token ids: the stages, each written and read again by the next.

All but the last return the columns of the documents they get. ``ORACLE_SQL`` is None: language
scores, signatures and a tokenizer can't be said in SQL. The tests hold ``run`` against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medalmart.llm.common import stored, table
from medalmart.llm.decontaminate import stage_decontaminate
from medalmart.llm.language import stage_language
from medalmart.llm.mixing import stage_mixing
from medalmart.llm.near_dup import stage_near_dup
from medalmart.llm.token_planes import stage_tokens

STAGES = [
    ("language", stage_language),
    ("near_duplicates", stage_near_dup),
    ("decontamination", stage_decontaminate),
    ("mixing", stage_mixing),
    ("tokens", stage_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
