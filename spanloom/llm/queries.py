"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .ann import search
from .decontaminate import decontaminate
from .html import main_text
from .jaccard import near_duplicates
from .langid import identify
from .lines import drop_recurring
from .mixing import plan
from .sharding import shard
from .surrogates import pseudonymize
from .warc import round_trip


#: The key of op7's query; a deployment passes a secret of its own.
PII_KEY = "spanloom"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "draws")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_recurring(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "n_entities", "text")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("url")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_line_templates": op4_line_templates,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_sharding": op6_sharding,
    "op7_surrogates": op7_surrogates,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_html_extraction": op9_html_extraction,
    "op10_warc": op10_warc,
}

#: The others: op1, op5 and op6 draw or hash, op3 and op9 learn, op4 and op7 depend on hashes; tests/llm holds them against brute force.
ORACLES = {"op2_decontamination": oracles.DECONTAMINATION, "op8_ngram_jaccard": oracles.JACCARD, "op10_warc": oracles.WARC}
