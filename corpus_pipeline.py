"""A corpus pipeline over ``documents``: language ID, near-dedup, decontamination, secret masking, packing.

Every stage but the last returns the columns of documents. Each result is written as Parquet in the shared folder and
read again as the next stage's input, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import decontaminate, language, packing, secrets, simhash
from cartolith.llm.common import read_table, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null texts, texts without a letter, and uncertain ones.

    Each row is judged by its own text; repeated rows and null or repeated doc_ids stay as they are. An empty table gives
    no rows; columns besides those of documents stay, whatever their names.
    """
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: shingles of five words, Jaccard 0.8 or more.

    Of a group the row with the least doc_id stays (a null one last; of several, the one whose text has the least hash),
    and of repeated rows one. Texts without words, null and empty ones, are one group. An empty table gives no rows;
    columns besides those of documents stay, whatever their names.
    """
    return simhash.keep_dissimilar(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, each row judged by its own text.

    Null and empty texts hold none and stay, and so does everything if the benchmark is empty. Null and repeated doc_ids
    and repeated rows need no care. An empty table gives no rows; other columns stay, whatever their names.
    """
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars follows the text (null for a null text).

    All rows stay, repeated ones too. An empty table gives no rows; other columns stay, whatever their names.
    """
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token windows.

    A null or empty text is its closing token alone; repeated rows are packed each; null doc_ids are carried. An empty
    table gives no rows; columns but doc_id and text are ignored.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]
#: No SQL: models, tokenizer and trees are not expressible; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
