"""The queries of this subpackage: one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]

#: Files of public tokenizers, by what they serve.
BYTE_BPE = "byte_bpe_50k.json"
#: A vocabulary of scored pieces.
PIECES = "piece_bpe_32k.model"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_simhash import digests

    return digests(read_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_bpe import digests

    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_lines import digests

    return digests(read_table(spark, sf_dir, "documents"), min_docs=10)


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_lattice import score

    return score(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_toxicity import digests

    return digests(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.7)


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_maxscore import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_sharding import digests

    return digests(read_table(spark, sf_dir, "documents"), shards=40)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_repeats import digests

    return digests(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_pii import digests

    return digests(read_table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_decontam import search

    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which is built on this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    named = [op1_simhash, op2_bpe, op3_lines, op4_lattice, op5_toxicity, op6_maxscore, op7_sharding, op8_repeats, op9_pii, op10_decontam, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from .op3_lines import ORACLE_SQL as lines
    from .op6_maxscore import ORACLE_SQL as search

    return {"op3_lines": lines, "op6_maxscore": search}
