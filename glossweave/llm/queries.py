"""The dealt operators as queries over whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_scratch_path
from . import codebooks, host_rules, language, latent, mixing, negatives, privacy, secrets, sharding, simhash, suffix_dedup, url_filter, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARDS = 8
URL_RULES = url_filter.rules_of(
    ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc_dictionary(spark, sf):
    folder = new_scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), folder)
    records = warc.read_archives(spark, folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_host_rules(spark, sf):
    judged = host_rules.judge_documents(table(spark, sf, "documents"))
    return judged.withColumn("host_rate", F.round("host_rate", 6))


@query
def op3_output_codes(spark, sf):
    return language.identify(table(spark, sf, "documents"))


@query
def op4_url_model_ratio(spark, sf):
    return url_filter.judge_urls(table(spark, sf, "pages"), URL_RULES)


@query
def op5_anchor_simhash(spark, sf):
    return simhash.digest_columns(simhash.near_duplicates(table(spark, sf, "documents")))


@query
def op6_jump_sharding(spark, sf):
    return sharding.assign_shards(table(spark, sf, "documents"), SHARDS)


@query
def op7_cover_suffixes(spark, sf):
    return suffix_dedup.deduplicate(table(spark, sf, "documents"))


@query
def op8_latent_retrieval(spark, sf):
    return latent.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op9_curriculum_mix(spark, sf):
    plan = mixing.training_plan(table(spark, sf, "documents"))
    first = F.get("positions", F.lit(0))
    rows = plan.select("doc_id", "size", "source_size", "target", "taken", "passes", first.alias("position"))
    return rows.orderBy("position", "doc_id")


@query
def op10_disclosure(spark, sf):
    return privacy.digest_columns(privacy.find_private(table(spark, sf, "documents")))


@query
def op11_trigram_secrets(spark, sf):
    return secrets.digest_columns(secrets.find_secrets(table(spark, sf, "documents")))


@query
def op12_hilbert_codebooks(spark, sf):
    return codebooks.digest_columns(codebooks.compress(table(spark, sf, "embeddings")))


@query
def op13_cover_negatives(spark, sf):
    return negatives.mine(table(spark, sf, "embeddings"))
