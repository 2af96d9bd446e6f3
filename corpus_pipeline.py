"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of documents; texts that a stage changes get a new n_chars.
Nulls, empty tables and repeated rows are handled as the operators' docstrings say. SQL
can't express the learned, hashed and rounded stages, so ORACLE_SQL is None; tests compare
every stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm import line_dedup, mixing, packing, simhash, toxicity
from duelframe.llm.common import crc_remainder, drop, scratch, table, written
from duelframe.llm.tokenizers import word_bpe

REJECT = 0.7
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below REJECT; labels teach by their training part."""
    labels = table(spark, sf_dir, "labels").where(crc_remainder("doc_id", 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), column="__toxicity")
    return scored.where(F.col("__toxicity") < REJECT).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them hold."""
    return _sized(line_dedup.dedup_lines(docs, min_docs=10, min_chars=1), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one_similar(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix reads, once for each reading, in training order."""
    return _sized(mixing.training_order(mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0), docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's place in sequences of at most 2048 tokens."""
    return packing.pack(docs, word_bpe, capacity=2048, end_id=0)


def _sized(changed: DataFrame, docs: DataFrame) -> DataFrame:
    out = changed.select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next reads it; of what is stored the last stage's table stays."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark, keep=1):  # what the stage left on its way, but for its result
            before, docs = docs, written(stage(spark, docs, sf_dir))
        drop(before)
    return docs
