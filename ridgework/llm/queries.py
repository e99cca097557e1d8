"""One query per operator over its whole table, with the columns their contracts fix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ridgework.llm import (
    contamination, fingerprints, language, licences, odd_sketches, oracle, packing, page_text, prefix_trie, quality, repeats, tool_calls, warc,
    whitening,
)
from ridgework.llm.tables import table

# What the implied tools take; one row per parameter.
TOOLS = [
    (name, parameter, kind, True)
    for name in ("ask", "follow_up")
    for parameter, kind in (("text", "string"), ("turn", "integer"), ("chars", "integer"))
]


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.turns_as_calls(table(spark, sf_dir, "conversations"))
    entries = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("name", "parameter", "type", "required"), row)]) for row in TOOLS]))
    schemas = spark.range(1).select(entries.alias("t")).select("t.*")
    return tool_calls.link_calls(calls, results, schemas)


def op2_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "__kept.n_bytes", "__kept.n_removed", "__kept.n_spans", F.col("__kept.sha256").alias("kept_sha256"),
        "__kept.n_word_runs", "__kept.n_run_words",
    )


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(contamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", F.col("capture.digest").alias("payload_digest"), F.col("capture.type").alias("record_type"), "refers_to"
    )


def op8_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *[f"__measures.{name}" for name in counts], "__verdict.base_failed", "__verdict.kept",
        F.array_join("__verdict.failed", ",").alias("failed_rules"),
    )


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", fingerprints.print_hex(F.col("print")).alias("fingerprint"), "component_id"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketches.near_copies(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_tool_call_linking, op2_residual_packing, op3_compression_language, op4_suffix_dedup, op5_licence_scan,
        op6_decontamination, op7_warc_captures, op8_style_tree, op9_quality_rules, op10_simhash_near_dedup,
        op11_whitening, op12_odd_sketches, op13_prefix_trie, pipeline,
    ]
    return {query.__name__: query for query in named}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle()
