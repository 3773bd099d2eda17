"""One query per text operator, over its whole table, and its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrain.llm import (
    decontamination, fingerprints, grammar, infill, language, manifest, near_duplicates, packing, repeats, search, secrets, toxicity, warc,
)
from tunegrain.plans.registry import Query, Run, table

LLM_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run: Run) -> Run:
        LLM_QUERIES[name] = Query(name, run, sql)
        return run

    return register


@query("op1_fingerprints")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, folder, "documents"))


@query("op2_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op3_repeats", repeats.REPEATS_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op4_secrets")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.scan_secrets(docs, secrets.train(docs))


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
        F.size("passages").alias("n_passages"),
    )


@query("op6_token_ids")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return grammar.encode_documents(table(spark, folder, "documents"))


@query("op7_decontamination", decontamination.CONTAMINATION_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


@query("op8_warc", warc.DERIVED_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, folder, "pages"))).drop("header", "block")


@query("op9_language")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.train(docs)).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query("op10_near_duplicates", near_duplicates.NEAR_DUPLICATES_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


@query("op11_fill_in_middle", infill.INFILL_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = infill.restore(infill.fill_in_middle(table(spark, folder, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query("op12_exact_search", search.PRODUCTS_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_products(table(spark, folder, "embeddings"))


@query("op13_manifest", manifest.MANIFEST_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.document_proofs(table(spark, folder, "documents")).drop("path")
