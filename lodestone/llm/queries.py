"""One query per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontaminate import contamination_report
from lodestone.llm.hard_negatives import hard_negatives
from lodestone.llm.html import extract_main_text
from lodestone.llm.imatch import imatch_report
from lodestone.llm.line_dedup import line_report
from lodestone.llm.mixing import mix
from lodestone.llm.occurrence import occurrence_report
from lodestone.llm.resampling import resampling_report
from lodestone.llm.sharding import shard_report
from lodestone.llm.simhash import simhash_report
from lodestone.llm.token_files import token_report
from lodestone.llm.toxicity import toxicity_report
from lodestone.llm.warc import build_derivatives, read_derivatives, response_records
from lodestone.session import shared_dir

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_WEIGHTS = {"domain": {"domain0": 3, "domain1": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}


def mix_levels() -> dict[str, Column]:
    """The tree of the mix. The documents name no domain, so their sources are grouped into four by number."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    return {"domain": F.concat(F.lit("domain"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


@query
def op1_decontaminate(spark, sf_dir):
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_simhash(spark, sf_dir):
    return simhash_report(table(spark, sf_dir, "documents"))


@query
def op4_token_files(spark, sf_dir):
    return token_report(table(spark, sf_dir, "documents"), shared_dir(spark, "tokens"), tokenizer())


@query
def op6_toxicity(spark, sf_dir):
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_main_text(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op10_imatch(spark, sf_dir):
    return imatch_report(table(spark, sf_dir, "documents"))


@query
def op8_sharding(spark, sf_dir):
    return shard_report(table(spark, sf_dir, "documents"))


@query
def op3_mixing(spark, sf_dir):
    chosen = mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, share=0.8, max_epochs=2)
    return chosen.select("doc_id", "domain", "lang", "source", "n_tokens", "copies", "used_tokens")


@query
def op7_line_dedup(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents"))


@query
def op9_warc(spark, sf_dir):
    responses = response_records(table(spark, sf_dir, "pages"))
    return read_derivatives(build_derivatives(responses, shared_dir(spark, "warc")))


@query
def op13_resampling(spark, sf_dir):
    return resampling_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_occurrence(spark, sf_dir):
    return occurrence_report(table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)
