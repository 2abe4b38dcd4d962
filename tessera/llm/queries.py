"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import oracles
from tessera.llm.language_id import language_id
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix_sources
from tessera.llm.near_dedup import near_dedup
from tessera.llm.packing import pack
from tessera.llm.quality_rules import quality_rules
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.suffix_dedup import suffix_dedup
from tessera.llm.url_filters import host_of, url_filter
from tessera.llm.vector_search import vector_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    out = pack(_table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20).select("query_id", "rank", "vec_id", "score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), shingle=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents")).withColumn("failed_rules", F.array_join("failed_rules", ","))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("max_")})


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages`` and their parents: three entries each, by the first digits of the key's MD5."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key is not null").distinct()
    labels = F.split("key", r"\.")
    parents = hosts.where(F.size(labels) > 2).select(F.array_join(F.slice(labels, 2, F.size(labels)), ".").alias("key")).distinct()
    x = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long")
    i = hosts.union(parents).distinct().select("key", x.alias("x"), F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
    listed = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("x") * (F.col("i") + 1) * 37 % 365).cast("int"))
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("drop")), ((F.col("x") + F.col("i")) % 3 + 1).cast("int"))
    return i.select("key", listed.alias("listed"), action.alias("action"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 365).cast("int"))
    return url_filter(pages.withColumn("fetched", fetched), dated_list(pages)).select("page_id", "host", "fetched", "kept", "entry_key", "entry_listed")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_curve_packing": op2_curve_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_vector_search": op5_vector_search,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_url_filters": op9_url_filters,
    "op10_mix_sources": op10_mix_sources,
}
ORACLES: dict[str, str] = {
    "op3_substring_dedup": oracles.OP3,
    "op4_quality_rules": oracles.OP4,
    "op6_suffix_dedup": oracles.OP6,
    "op7_line_dedup": oracles.OP7,
    "op8_minhash_near_dedup": oracles.OP8,
    "op9_url_filters": oracles.OP9,
}
