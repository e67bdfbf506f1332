"""Helpers of the operators: tables in the shared folder, checked broadcasts, groups in a sorted stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polarframe.operators.distribute import scratch_path

# Ids of eight bytes each: a broadcast of at most some tens of megabytes, counted before.
BROADCAST_IDS = 1_000_000
# Shuffle files go at the end of their query, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes of text that one vectorised step of a Python worker handles together (a longer text alone).
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, safe from lost executors.

    Nothing reads the shuffles of the write again, so Spark removes their files as soon as it is done.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, True)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drawn_share(share: float, *key: Column) -> Column:
    """Whether a hash of the key falls in the lowest ``share`` of 63-bit numbers; no share of a table is too small for that."""
    return F.xxhash64(*key).bitwiseAND(F.lit(2**63 - 1)) <= F.lit(min(int(share * 2**63), 2**63 - 1))


def fixed(value: Column) -> Column:
    """``value``, computed once a row at this place.

    The optimizer copies a column's expression into lambdas and into filters that it pushes down, where it would run once
    per element. It leaves expressions alone that count as non-deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def join_checked(df: DataFrame, ids: DataFrame, on: list[str] | Column, how: str = "inner") -> DataFrame:
    """Join a table of narrow rows: broadcast if it counts below the bound, else a shuffle that AQE may split."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def steps(batches: Iterator[pa.RecordBatch], text: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``size`` bytes together."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys in a stream that is sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = tuple(c[0] for c in columns) != last
        last = tuple(c[-1] for c in columns)
        borders = np.flatnonzero(change).tolist()
        at = 0
        for border in [*borders, batch.num_rows]:
            if border > at:
                held.append(batch.slice(at, border - at))
            if border < batch.num_rows and held:
                yield pa.Table.from_batches(held)
                held = []
            at = border
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, text: str, size: int = 1 << 20) -> Iterator[pa.Table]:
    """Blocks of whole groups from a stream that is sorted by ``key``: about ``size`` bytes of text, or one larger group."""
    held: list[pa.RecordBatch] = []
    last, pending = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(batch.schema.get_field_index(key)))
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))]).tolist()
        fresh = np.ones(len(k), bool)
        fresh[1:] = k[1:] != k[:-1]
        fresh[0] = k[0] != last
        last, at = k[-1], 0
        for border in np.flatnonzero(fresh).tolist():
            if pending + ends[border] - ends[at] >= size:
                if border > at:
                    held.append(batch.slice(at, border - at))
                yield pa.Table.from_batches(held).combine_chunks()
                held, pending, at = [], 0, border
        held.append(batch.slice(at))
        pending += ends[-1] - ends[at]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its connected component.

    Each round maps every node to its smallest neighbour (or itself), follows that map four steps, contracts the
    graph by it, and composes the maps: a star is done in two rounds, a chain shrinks to a quarter a round. Every step is an
    aggregate or a join of narrow rows; only whether edges remain reaches the driver. Loops and repeated edges do no harm.
    """
    graph = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    graph = stored(graph.distinct(), "edges")
    roots = None
    while True:
        both = graph.union(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "labels")
        for _ in range(2):
            ahead = step.select(F.col("a").alias("to"), F.col("to").alias("next"))
            step = step.join(ahead, "to").select("a", F.col("next").alias("to"))
        step = stored(step, "labels")
        if roots is None:
            roots = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            roots = roots.join(step.withColumnRenamed("a", "root"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            )
        ends = graph.join(step.select("a", F.col("to").alias("x")), "a").join(
            step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b"
        )
        graph = stored(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if graph.isEmpty():
            return stored(roots, "roots")
