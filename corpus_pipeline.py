"""The corpus pipeline over documents: language ID, exact and near deduplication, mixing and packing.

Of every stage but the last: the columns stay, whatever they are named and however many there are; nulls may be in any
column; texts are taken whole, however long; an empty table gives an empty one; what ties and repeated rows become is
said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tissuelake.llm.common import written
from tissuelake.llm.exact_dedup import drop_exact_copies
from tissuelake.llm.langid import identified_documents
from tissuelake.llm.mixing import mixed_documents
from tissuelake.llm.packing import pack
from tissuelake.llm.simhash import drop_near_copies
from tissuelake.session import with_package

#: SQL can't express language ID and packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined stay; null and empty texts and texts without letters go.

    Languages that are equally likely don't matter here. Rows that repeat an id or a text are judged each. A null id and
    a null label only keep a row from teaching, not from staying.
    """
    with_package(spark)
    return identified_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the one of smallest doc_id stays.

    Null texts count as empty. A null id is larger than any other; of rows that repeat id and text one stays.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles, the one of smallest doc_id stays.

    Null texts count as empty, texts of fewer words as one shingle, texts without words as alike. A null id is larger
    than any other. Rows that share an id stay or go together, with the row that decides.
    """
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to twice, or not at all.

    Null texts have no words; a null source is the last one. Draws are ordered by a hash, ties by id, so that reruns
    agree. Rows that share an id are taken as often as the most taken of them.
    """
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens, in packing's own columns.

    A null text is empty, and an empty one its end token. Rows that repeat an id are packed each; pieces of equal
    length are dealt by id. Longer documents are cut. An empty table gives an empty one.
    """
    return pack(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read as the next one's input."""
    docs = with_package(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
