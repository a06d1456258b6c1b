"""Corpus pipeline: quality rules, line dedup, near duplicates, source mixing, byte-level BPE.

Each stage works on all that its predecessor kept; its rows are written as Parquet in the shared
folder and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkseries.llm.bpe import stage_byte_bpe
from sparkseries.llm.common import materialize, table
from sparkseries.llm.line_dedup import stage_line_dedup
from sparkseries.llm.mixing import stage_mixing
from sparkseries.llm.ngram_join import stage_near_duplicates
from sparkseries.llm.quality import stage_quality

STAGES = [
    ("quality rules", stage_quality),
    ("line dedup", stage_line_dedup),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("mixing sources to target weights", stage_mixing),
    ("byte-level BPE", stage_byte_bpe),
]

#: The forest, the dual and the encoder have no SQL form; tests compare each stage with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
