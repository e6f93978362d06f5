"""The corpus pipeline: each stage works on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of documents; the last returns the encoded documents. Between the stages
the rows are written as Parquet into the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvtide.llm.common import read, sweep, swept_from, written
from kvtide.llm.mixing import stage_mixing
from kvtide.llm.pieces import stage_pieces
from kvtide.llm.quality import stage_quality
from kvtide.llm.simhash import stage_simhash
from kvtide.llm.suffix_dedup import stage_suffix_dedup

STAGES = [
    ("quality rules", stage_quality),
    ("simhash near-dedup", stage_simhash),
    ("suffix-array dedup", stage_suffix_dedup),
    ("mixing", stage_mixing),
    ("sentencepiece", stage_pieces),
]

#: SQL can't express the sketches, the fingerprints or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs, before = read(spark, sf_dir, "documents"), swept_from()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
            sweep(spark, before, keep=1)  # what led to this table isn't read again
    return docs
