"""A training-data pipeline over ``documents``: five stages, each one operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the rows that the next stage gets, with the columns of ``documents``
(the last stage returns digests of the encoded texts). Rows that a stage keeps
stay whole but for what the stage decides: lines that line dedup drops are gone
from ``text``, and ``n_chars`` follows.

Every stage takes null and empty texts, repeated rows, null ids and empty
tables as its operator defines them: a null or empty text is not toxic unless
the model says so of an empty text, is one empty line, has fingerprint zero
(of which one row stays), holds no benchmark item and has no tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quiverql.llm import op1_simhash, op2_bpe, op3_lines, op5_toxicity, op10_decontam
from quiverql.llm.common import Written, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document goes when its toxicity reaches this; a line when this many documents have it.
TOXIC, MIN_DOCS = 0.7, 10
#: Words of a shingle in near-duplicate search.
WORDS = 5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``."""
    model = op5_toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return op5_toxicity.below(docs, model, TOXIC)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ``MIN_DOCS`` documents share."""
    return op3_lines.dedup_lines(docs, MIN_DOCS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of five-word shingles): the one with the smallest id."""
    return op1_simhash.one_of_each(docs, op1_simhash.similar(docs, WORDS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return op10_decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of the ids and of the decoded text."""
    return op2_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The fitted stages cannot be written in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet in the shared folder and read again."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        written = Written(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
