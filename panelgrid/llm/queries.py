"""One query per operator, over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelgrid.llm.common import documents
from panelgrid.llm.exact_copies import copy_digests
from panelgrid.llm.fingerprints import compare_with_next
from panelgrid.llm.jaccard_join import near_groups
from panelgrid.llm.language import identify
from panelgrid.llm.packing import pack
from panelgrid.llm.quality import load_labels, quality_rules
from panelgrid.llm.secret_scan import scan_digests
from panelgrid.llm.sharding import shard_by_bytes
from panelgrid.llm.substring_dedup import dedup_substrings
from panelgrid.llm.suffix_dedup import dedup_digests
from panelgrid.llm.tokens import encode_digests
from panelgrid.llm.whitening import whitened_components
from panelgrid.llm.word_runs import run_digests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@register("op1_ngram_jaccard")
def op1(spark, sf_dir):
    return near_groups(documents(spark, sf_dir))


@register("op2_sentence_spans")
def op2(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return dedup_substrings(docs.select("doc_id", "text"))


@register("op4_closed_syncmers")
def op4(spark, sf_dir):
    return compare_with_next(documents(spark, sf_dir))


@register("op3_minimax_shards")
def op3(spark, sf_dir):
    return shard_by_bytes(documents(spark, sf_dir))


@register("op5_length_buckets")
def op5(spark, sf_dir):
    return pack(documents(spark, sf_dir))


@register("op7_ngram_ratio")
def op7(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir), load_labels(spark, sf_dir))


@register("op8_byte_bpe")
def op8(spark, sf_dir):
    return encode_digests(documents(spark, sf_dir),
                          public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@register("op6_ppm_language")
def op6(spark, sf_dir):
    return identify(documents(spark, sf_dir))


@register("op9_layered_secrets")
def op9(spark, sf_dir):
    return scan_digests(documents(spark, sf_dir))


@register("op10_suffix_arrays")
def op10(spark, sf_dir):
    return dedup_digests(documents(spark, sf_dir))


@register("op13_word_runs")
def op13(spark, sf_dir):
    return run_digests(documents(spark, sf_dir))


@register("op11_polynomial_copies")
def op11(spark, sf_dir):
    return copy_digests(documents(spark, sf_dir))


@register("op12_chebyshev_whitening")
def op12(spark, sf_dir):
    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
