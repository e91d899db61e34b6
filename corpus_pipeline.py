"""From raw documents to token ids in five stages over the text operators.

Each stage works on all rows that the one before it has kept and is written as Parquet in the
shared folder before the next one reads it, so that a lost executor costs a re-read of files.

* quality: documents that score below the acceptance threshold go, among them empty ones.
* near_duplicates: of each group of near copies (SimHash over three-word shingles, 3 bits) the document with the
  smallest doc_id stays.
* decontamination: documents that share a window of words with a benchmark item go.
* secrets: every secret in a text is replaced by a mask, and n_chars is counted anew.
* tokens: the texts become piece ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chaintally.llm import contamination, crf_quality, pieces, secret_ledger, simhash
from chaintally.llm.common import read
from chaintally.llm.queries import vocabulary_path
from chaintally.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark, docs, sf_dir):
    return crf_quality.keep_good(docs, read(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    return simhash.keep_one(docs).select(*COLUMNS)


def decontamination(spark, docs, sf_dir):
    return contamination.remove_documents(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets(spark, docs, sf_dir):
    return secret_ledger.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def tokens(spark, docs, sf_dir):
    """doc_id, lang, source, n_tokens, ids."""
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary_path()).select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("tokens", tokens)]

#: The quality score, the fingerprints and the merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
