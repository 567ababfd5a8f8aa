"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of documents (extra columns, whatever their names, go along).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.decontaminate import keep_clean
from quernstone.llm.exact import keep_exact
from quernstone.llm.language import fit, fold, keep_identified
from quernstone.llm.neardup import keep_near
from quernstone.llm.pieces import encode_pieces
from quernstone.session import shared_root, ship, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a learned language is found.

    Rejected are null texts, texts without a letter, and those no more like the language found than like chance (another
    script, rows of the keyboard). Learned is from the rows whose crc32(doc_id) mod 4 is not 2; with no labels at all,
    every text with a letter stays. Ties, repeated rows and null ids are decided row by row; an empty table stays empty.
    """
    ship(spark)
    learn = ~F.coalesce(fold("doc_id", 4) == 2, F.lit(True))
    return keep_identified(docs, fit(docs.filter(learn)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id stays; repeated rows leave one.

    A null doc_id is smaller than any other.
    """
    ship(spark)
    return keep_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id (five words, 0.8).

    A row goes for its own text, never for another row of its doc_id; null ids, null and empty texts stay.
    """
    ship(spark)
    return keep_near(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a copy of a benchmark item, edited or not, go, with or without a doc_id; null and empty texts stay."""
    ship(spark)
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids of every text; ``round_trip`` tells that decoding them gave back the text (null and empty: no ids).

    Columns named ids, n_ids or round_trip are replaced, all others stay.
    """
    ship(spark)
    return encode_pieces(docs)


STAGES = [
    ("language identification", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("benchmark decontamination", decontaminate),
    ("subword encoding", pieces),
]

#: SQL can express neither the learned language model nor the alignment; tests run a brute-force version instead.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a Parquet table in the shared folder between them."""
    at = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
            if k:  # whole and written: the table it was made from is needed no more
                _remove(spark, f"{at}/{k - 1}")
    return docs
