"""The corpus pipeline: each stage works on all that the one before it kept.

documents -> quality (what the classifier rejects goes) -> near duplicates (one document of each group stays) -> repeated
passages (each stays in its first document) -> contamination (contaminated documents go) -> token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontaminate, minhash, quality, substring
from weftline.llm._shared import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of the best grade; all of them where no label is given. Null and empty texts are graded like
    others, repeated rows alike; an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component; all documents without words (null, empty); a repeated row once; rows with a
    null id where no other document of their component has one."""
    return minhash.keep_one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id has; n_chars is their new length. Rows with a null id or text stay as
    they are; those that lose all their words go."""
    return substring.without_passages(docs, n_chars="n_chars")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the test items of `benchmark`: all of them where it is empty; null and empty texts stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, their digest and that of the bytes that they decode to; null and empty texts have no ids."""
    rows = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decoded_sha256="decoded_sha256")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest().alias("ids_sha256"), "decoded_sha256", "ids")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("contamination", keep_uncontaminated),
    ("tokens", encode),
]
#: SQL can't express the classifier, the alignment of passages or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from all documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
