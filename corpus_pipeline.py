"""Documents through five operators: each stage works on all that the one before kept, read back from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dependra.llm.common import Scratch, table
from dependra.llm.decontaminate import leak_stage
from dependra.llm.lines import line_stage
from dependra.llm.mixing import mixing_stage
from dependra.llm.neardup import neardup_stage
from dependra.llm.quality import quality_stage

STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", leak_stage),
    ("mixing", mixing_stage),
]

#: No SQL has zstandard: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}_{name}")
        if i:
            scratch.drop(f"{i - 1}_{STAGES[i - 1][0]}")
    return docs
