"""Queries of the training-data operators over the synthetic tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_digests
from .chat import chat_digests, format_chats
from .common import shared_dir, table
from .exact_dedup import EXACT_DEDUP_SQL, exact_dedup
from .html_extract import extract_main
from .licenses import LICENSES_SQL, as_files, scan_licenses
from .packing import pack
from .quality import fit_quality, quality_rules
from .simhash import simhash_components
from .suffix_dedup import repeat_digests
from .warc import WARC_SQL, read_archives, write_archives


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = as_files(table(spark, sf_dir, "documents"))
    return files.select("doc_id", "path").join(scan_licenses(files), "path")


#: The executors open it, so it names a file that every machine has.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


#: A conversation that is all control strings, added to the table.
CONTROL_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(CONTROL_CHAT, "conv_id long, turn long, role string, text string")
    return chat_digests(format_chats(chats.unionByName(added)))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, manifest, folder).drop("url")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_bpe": op3_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_chat": op5_chat,
    "op6_html": op6_html,
    "op7_quality": op7_quality,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_licenses": LICENSES_SQL,
    "op4_exact_dedup": EXACT_DEDUP_SQL,
    "op9_warc": WARC_SQL,
}
