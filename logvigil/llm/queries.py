"""One query per operator, over its whole table with production parameters; SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logvigil.llm import (
    decontaminate, exact_dedup, licences, line_dedup, packing, periodic_runs, prefix_trie, secret_scan, simhash, substring, token_counts, token_files, toxicity,
)
from logvigil.llm.common import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_retrieval_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0, window=1024)


@_query("op2_golay_simhash")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"), k=3, bits=3)


@_query("op3_token_files")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, place)
    return token_files.read_tokens(spark, place)


@_query("op4_site_line_dedup", line_dedup.CHECK)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, folder, "documents"))


@_query("op5_weak_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query("op6_chained_passages")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return substring.repeated_passages(table(spark, folder, "documents"))


@_query("op7_licence_scan")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(table(spark, folder, "documents"))


@_query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


@_query("op9_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
 g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@_query("op10_template_decontamination")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query("op11_secret_scan")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, folder, "documents"))


@_query("op12_prefix_trie")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"), lead=True)


@_query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.find_runs(table(spark, folder, "documents"), plant=True, whole=False)
