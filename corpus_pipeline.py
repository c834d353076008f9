"""From raw documents to token files: rules, near copies, contamination, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's documents;
all but the last return the columns of ``docs``.  Each works on all rows it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetflow.llm import decontaminate, mixing, near_dedup, quality_rules, token_files
from packetflow.llm.tables import table
from packetflow.session import new_folder, settle


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs certified on the labels."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies."""
    return near_dedup.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: doc_id, start, n_tokens, ids_crc32 of every copy."""
    path = new_folder(spark, "tokens")
    token_files.write_tokens(docs, path, token_files.tokenizer_path())
    return token_files.read_tokens(spark, path)


STAGES = [
    ("quality_rules", good_documents),
    ("near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixture),
    ("token_files", tokens),
]

#: Consistent weighted sampling and the tokenizer have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
