"""A corpus pipeline of five stages over `documents`.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldt.llm import jaccard, mixing, packing, quality, suffix_dedup
from veldt.llm.shared import stages, table, written
from veldt.llm.tokens import tokenizer_path


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents in sequences of 2048 tokens. A null text is one piece, the end id; repeated rows
    (the mix takes a document up to twice) are packed each for itself; other columns are not looked at; an empty table
    gives no rows."""
    return packing.pack(packing.pieces(docs, tokenizer_path(), 0, 2048), 2048)


STAGES = stages(
    [
        ("quality", quality.stage),
        ("near_duplicates", jaccard.stage),
        ("repeated_strings", suffix_dedup.stage),
        ("mixing", mixing.stage),
        ("packing", pack),
    ]
)

#: A fitted classifier and shared packing are beyond SQL; tests/llm/test_stages.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        docs = written(found, name)
    return STAGES[-1][1](spark, docs, sf_dir)
