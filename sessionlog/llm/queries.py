"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, exact_dedup, filter_audit, jaccard_join, language_id, license_scan, mixing, packing, posting_lists, quality, sharding, substring_dedup, top_k
from ._store import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": lambda spark, d: mixing.op1(documents(spark, d)),
    "op2_sharding": lambda spark, d: sharding.op2(documents(spark, d)),
    "op3_quality": lambda spark, d: quality.op3(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op4_substring_dedup": lambda spark, d: substring_dedup.op4(documents(spark, d)),
    "op5_packing": lambda spark, d: packing.op5(documents(spark, d)),
    "op6_language_id": lambda spark, d: language_id.op6(documents(spark, d)),
    "page_language_id": lambda spark, d: language_id.identify_pages(spark.read.parquet(f"{d}/pages.parquet"), documents(spark, d)),
    "op7_jaccard_join": lambda spark, d: jaccard_join.op7(documents(spark, d)),
    "op8_license_scan": lambda spark, d: license_scan.op8(documents(spark, d)),
    "op9_top_k": lambda spark, d: top_k.op9(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op10_exact_dedup": lambda spark, d: exact_dedup.op10(documents(spark, d)),
    "op11_conversation_repair": lambda spark, d: conversation_repair.op11(spark.read.parquet(f"{d}/conversations.parquet")),
    "op12_posting_lists": lambda spark, d: posting_lists.op12(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op13_filter_audit": lambda spark, d: filter_audit.op13(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
}

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op9_top_k": top_k.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
