"""The operators on their whole tables, as the driver calls them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from deskwise.llm import conversations, decontaminate, groups, hosts, language, licenses, lines, packing, personal, quality, spelling, spots, token_codes
from deskwise.llm.common import fresh_path, table

#: Fixed values of the URL query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the package of public tokenizers has a file."""
    return public_tokenizers.path(name)


def op1_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.similar_components(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_data(table(spark, sf_dir, "documents"))


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-codes")
    token_codes.write_codes(table(spark, sf_dir, "documents"), tokenizer_path(), path)
    return token_codes.read_documents(spark, path)


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(language.training_rows(docs))
    found = language.predict(docs.select("doc_id", "text", language.held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_symbol", "accepted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.fingerprints(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.weights(docs, table(spark, sf_dir, "labels")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_groups": op1_jaccard_groups,
    "op2_personal_data": op2_personal_data,
    "op3_token_codes": op3_token_codes,
    "op4_host_reputation": op4_host_reputation,
    "op5_decontaminate": op5_decontaminate,
    "op6_language": op6_language,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_spot_signatures": op9_spot_signatures,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {"op4_host_reputation": hosts.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_quality_rules": quality.ORACLE}
