"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixture, token files.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its result is written as Parquet and
read again as the next one's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import decontam, minhash, mixing, quality, wavelet
from signalloom.llm.common import keep, table
from signalloom.llm.queries import default_tokenizer, n_words


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return quality.cascade(docs).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles."""
    return minhash.without_near_duplicates(docs, width=5, per_cent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a near copy of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: a document taken twice is two rows, one not taken is none."""
    mixed = mixing.mix_sources(docs, n_words(F.col("text")), F.xxhash64("text"))
    return mixing.emit(mixed, docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture; per row what is read back from them: doc_id, start, n_tokens, ids_crc32."""
    return wavelet.token_index(docs, F.xxhash64("text"), default_tokenizer())


STAGES = [
    ("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontaminate), ("source mix", mix_sources),
    ("token files", token_files),
]

#: Token ids are out of SQL's reach; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, f"stage-{i}")
    return docs
