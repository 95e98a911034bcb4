"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, toxicity
from .fingerprint import edited_fingerprints
from .linededup import dedup_lines
from .mixing import mix_sources
from .neardup import near_duplicates
from .packing import pack
from .quality import quality_rules
from .repeats import remove_repeats
from .sharding import shard


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.disclosures(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), lambda k: k == F.lit(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts[:4], F.sha2(pii.listed(F.col("spans"), True), 256).alias("base_sha256"), pii.listed(F.col("spans"), False).alias("spans"), counts[4])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels").select("doc_id", "toxic")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"), clean=False, keep=["doc_id"])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), keep=["doc_id", "source", "lang"])


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), length=400, keep="none")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_toxicity, op3_quality_rules, op4_line_dedup, op5_mixing, op6_fingerprints, op7_packing, op8_sharding, op9_repeats, op10_near_duplicates)}


def oracle_sql() -> dict[str, str]:
    return {}
