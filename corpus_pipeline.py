"""From raw documents to token ids: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Every stage works on rows, keeps all columns whatever their names, and changes nothing but the text and n_chars (line dedup).
Defined cases: null and empty texts pass all stages and end as no ids; a null id holds no line, links with nothing and stays;
of rows equal in id and text one stays, if the text has a word, and of rows that share only the id each is judged by its own
text; very long texts are read whole in every stage; ties go to the smaller doc_id (Jaccard) or the larger (line dedup); an
empty table gives an empty result; without labels the general word list judges toxicity, without items nothing is
contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.llm.byte_bpe import encode_documents
from tracelark.llm.common import Scratch
from tracelark.llm.decontaminate import drop_contaminated
from tracelark.llm.line_dedup import dedup_documents
from tracelark.llm.ngram_join import one_of_each_group
from tracelark.llm.toxicity import drop_toxic, learn


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    return drop_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, except in the largest doc_id that holds them; every document stays."""
    return dedup_documents(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every text, with digests of ids and of what they decode to."""
    import public_tokenizers

    got = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids"
    )


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: A trained classifier and a byte-pair encoder stand in the way of SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents table; what a stage returns is written to the shared folder and read by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
