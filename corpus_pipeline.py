"""A corpus pipeline: quality, near-duplicates, benchmark passages, personal data, byte-level BPE.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
Stages but the last keep the columns of documents.  The last adds n_tokens, ids and the bytes decoded from them (with
underscores before the name where documents have such a column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, dsir, minhash, pii, wumanber
from ledgerline.llm.common import cut, discard, fresh, pack, scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    return dsir.resample(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8)."""
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return wumanber.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; n_chars follows the text."""
    done = pii.redact(pii.detect(docs), docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, and the bytes that these stand for."""
    import public_tokenizers

    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    done = bpe.decode(bpe.encode(pack(docs, text="text"), vocabulary).drop("text"), vocabulary)
    made = ("n_tokens", "ids", "decoded")
    return done.select(*(F.col("doc")[c].alias(c) for c in docs.columns), *(F.col(c).alias(n) for c, n in zip(made, fresh(docs, *made), strict=True)))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("byte-level BPE", encode),
]

#: Neither hashed n-gram models nor byte-level BPE can be put as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves in the shared folder goes when the next one's input is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as own:
            done = own.keep(cut(stage(spark, docs, sf_dir), name.replace(" ", "-").lower()))
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
