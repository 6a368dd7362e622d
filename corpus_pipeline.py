"""Corpus pipeline: quality, near-duplicates, benchmark contamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import packed, passing_tables, table, to_table
from quillspark.llm.decontamination import find_contamination
from quillspark.llm.jaccard import keep_one
from quillspark.llm.packing import pack_documents
from quillspark.llm.pii import pseudonymise_checked
from quillspark.llm.quality import score_quality, train
from quillspark.llm.queries import bpe_path, pii_key


def _row(docs: DataFrame) -> DataFrame:
    """`row`, all other columns as a struct, and text: whatever columns docs has, none clashes with those that operators add."""
    return packed(docs, "text")[0]


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*packed(docs, "text")[1]())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.5 or more), with all their columns.

    Null and empty texts get the share of good texts in the sample as score; repeated rows are judged each and alike; an
    empty table stays empty. Very long texts are read whole; columns of any other name pass through.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return _columns(score_quality(_row(docs), model).where("score >= 0.5"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more): that of the
    smallest doc_id, nulls last; of rows equal in doc_id and text one.

    Null, empty and blank texts are one component; an empty table stays empty. Very long texts are read whole; columns of
    any other name pass through.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, with all their columns.

    Null and empty texts have no words and stay; repeated rows are judged each and alike; an empty table stays empty, an
    empty benchmark removes nothing. Very long texts are read whole; columns of any other name pass through.
    """
    return _columns(find_contamination(_row(docs), table(spark, sf_dir, "benchmark")).where("n_hit = 0"), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data; n_chars, where docs has it, follows the text. The rows are written
    once and searched for surrogates of two entities, an error.

    Null texts stay null, with their n_chars; repeated rows get equal texts; an empty table stays empty. Very long texts are
    read whole; columns of any other name pass through.
    """
    out = pseudonymise_checked(_row(docs), pii_key(spark))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, with their token ids (unsigned 32-bit, little-endian); rows
    and edge cases as in pack_documents."""
    return pack_documents(docs, bpe_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", personal_data), ("packing", packing)]
ORACLE_SQL = None  # classifiers, surrogates and packing have no SQL; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. A stage's tables, and its predecessor's result, are deleted when its own result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with passing_tables(spark) as made:
            docs = to_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
            result = made.pop()
            if before:
                made.append(before)
        before = result
    return docs
