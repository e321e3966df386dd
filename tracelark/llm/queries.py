"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from .byte_bpe import bpe_digest
from .class_lm import class_lm_digest
from .decontaminate import find_contamination
from .graph_ann import nearest_neighbours
from .html_extract import extract_main_text
from .language_id import language_digest
from .license_scan import scan_licences
from .line_dedup import line_digest
from .ngram_join import join_ngrams
from .toxicity import toxicity_digest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm_digest(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(table(spark, sf_dir, "documents"))


def op8_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_class_lm, op3_language_id, op4_license_scan, op5_toxicity, op6_html_extract, op7_ngram_jaccard, op8_graph_ann, op9_byte_bpe, op10_line_dedup)
}

OP10_SQL = """
WITH lines AS (
    SELECT rid, doc_id, u.pos, u.line,
           translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
         LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
), hot AS (
    SELECT k, max(doc_id) AS keep_doc FROM lines WHERE length(k) >= 20 AND doc_id IS NOT NULL
    GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT l.rid, l.doc_id, l.pos, l.line, (h.k IS NOT NULL AND l.doc_id < h.keep_doc) AS gone
    FROM lines l LEFT JOIN hot h ON l.k = h.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE coalesce(gone, false)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""

ORACLE: dict[str, str] = {"op10_line_dedup": OP10_SQL}
