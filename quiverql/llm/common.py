"""What several operators share: shared-folder tables, Arrow plumbing, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import SharedPath


class Written:
    """A frame written as Parquet in the shared folder.

    ``drop`` deletes it; a table that a lazy result still reads is deleted when
    the driver's file system is closed, at the latest when the driver ends.
    """

    def __init__(self, df: DataFrame):
        self._place = SharedPath(df.sparkSession)
        df.write.parquet(self._place.path)
        self.df = df.sparkSession.read.schema(df.schema).parquet(self._place.path)

    def drop(self) -> None:
        self._place.drop()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow``: batches stay columnar and bounded by Spark's byte limit. A reused worker first gives back what it no longer needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what Python makes of them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Return free memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_texts(docs: DataFrame) -> DataFrame:
    """Only the two columns that operators read; others, whatever their names, never reach a shuffle."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph, by alternating large-star and small-star steps.

    ``edges`` has two long columns ``u`` and ``v`` in any order, with repeats
    and loops allowed. Returns ``node`` and ``root`` (the component's smallest
    node, unsigned order is not used) for every node that has an edge to
    another one. Each step is a minimum per node (map-side combined) and an
    equi-join, so no neighbourhood is gathered in one place; each round is
    written to the shared folder and the round before is deleted.
    """
    spark = edges.sparkSession
    u, v = F.col("u"), F.col("v")
    now = Written(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    seen = None
    while True:  # the steps settle on any graph
        both = now.df.select(u, v).unionAll(now.df.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour is linked to the smallest of the neighbourhood
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v)
        after = Written(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        mark = after.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        now.drop()
        now = after
        if mark == seen:
            break
        seen = mark
    members = now.df.select(u.alias("node"), v.alias("root"))
    return members.unionAll(members.select(F.col("root").alias("node"), "root").distinct())


def local_spark(name: str = "quiverql-llm", cores: int = 4) -> SparkSession:
    """Session for tests."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
