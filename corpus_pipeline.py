"""Corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, piece encoding.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and
reread as the next stage's docs. All stages but the last return the columns of the documents table, whatever
their names. Every stage takes null, empty and very long texts, null and repeated ids, repeated rows and empty
tables; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from explainkit.llm import containment, passages, pieces, quality, queries, simhash
from explainkit.plans.storage import persist_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep. Null, empty and wordless texts go; repeated rows and null ids are judged one
    by one; a ratio equal to its cutoff is kept."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, and of its rows the one with the
    smallest text. Rows without an id stay; wordless texts are one group."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document (smaller id) holds. What was nothing but repeats goes; null
    and wordless texts and null ids stay; of an id with several texts the smallest is cut, the others stay."""
    return passages.remove_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 or more. Null and wordless texts hold none; repeated rows and null ids
    are judged one by one; an empty benchmark keeps all."""
    return containment.keep_uncontaminated(docs, queries.read(spark, sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of its decoded text: a row for each row, null text as empty text."""
    return pieces.piece_digests(docs, queries.vocabulary(queries.PIECES))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece", piece_encoding),
]

#: The cutoffs and fingerprints of the stages have no equivalent in SQL; tests hold every
#: stage to SQL, brute force or the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and reread."""
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
