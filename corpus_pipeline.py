"""The corpus pipeline: documents in, packed training sequences out.

Every stage reads what its predecessor wrote. The first four return the columns of ``documents``: texts
without a language go, one document of each class of near duplicates stays, passages that repeat are cut
out of the texts, and documents that hold a benchmark window go. The last returns the packed pieces.
"""

from __future__ import annotations

from keyloom.llm import decontam, langid, neardup, packing, suffixes
from keyloom.llm.common import dropped, written

STAGES = [
    ("language_id", langid.stage),
    ("near_dedup", neardup.stage),
    ("suffix_dedup", suffixes.stage),
    ("decontamination", decontam.stage),
    ("packing", packing.stage),
]

#: None: near duplicates, packing and the learned language cannot be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The last stage's rows; a stage's table is deleted once its successor's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
