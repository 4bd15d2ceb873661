"""One query for each operator, over the whole of its table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontam, html_extract, langid, license_scan, line_dedup, media, pii, superminhash, token_store

#: Text of every document; nothing else of the table reaches an operator unless it is named.
DOCUMENTS = ("doc_id", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(number, pii.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.groups(table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(documents, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.written_places(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(media.sniff(media.store_texts(table(spark, sf_dir, "documents"))))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_main_text, op2_bpe, op3_personal_data, op4_near_dedup, op5_licenses, op6_language, op7_token_store, op8_decontaminate, op9_media, op10_line_dedup)}

ORACLE_SQL: dict[str, str] = {"op5_licenses": license_scan.oracle()}
