"""Exact top-k inner products with a vector-approximation file.

Every vector is approximated by a small cell number per dimension; cell borders are quantiles of that dimension over
all rows. Blocks of queries scan blocks of approximations: the cells give a lower and an upper bound of each score.
A candidate stays if its upper bound reaches the kth largest lower bound of its query, first inside its block, then
over all blocks. Only those candidates' exact vectors are read (by a join), and the k best exact scores are certain,
because no other vector's bound reaches the kth.

Every query meets every vector, as a top-k search must: ``blocks x query blocks`` tasks of bounded size, each a few
matrix products over cells. Nothing depends on groups of equal vectors; ties go to the smaller id, so copies are
ranked by id.

Null vectors and vectors with null or non-finite components take no part. Vectors of different lengths never meet.
Rows that repeat an id are candidates of their own. A query sees all rows but those with its own id; rows with a
null id can't be queried and are dropped. No rows, no queries or no candidates give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polarframe.llm.shared import stored

CELLS = 256
BLOCK_ROWS = 4096
QUERY_ROWS = 512


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, row, dim, v): whole numbers floor(scale * x) of the vectors that take part."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vec_col, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.monotonically_increasing_id().alias("row"),
        F.size(vec_col).alias("dim"), whole.alias("v"),
    )


def cell_borders(rows: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """Per vector length a matrix (dimension, cells + 1) of borders: quantiles, and the extremes at the ends."""
    inner = [i / cells for i in range(1, cells)]
    stats = rows.select("dim", F.posexplode("v").alias("pos", "x")).groupBy("dim", "pos").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", inner).alias("inner")
    )
    found: dict[int, dict[int, list[int]]] = {}
    for r in stats.collect():  # one row a dimension, whatever the number of vectors
        found.setdefault(r["dim"], {})[r["pos"]] = [r["low"], *r["inner"], r["high"]]
    return {dim: np.array([at[p] for p in range(dim)], dtype=np.float64) for dim, at in found.items()}


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    scale: float = 256.0, cells: int = CELLS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query; all, if there are fewer."""
    rows = stored(usable(vectors, id_col, vec_col, scale), "vectors")
    asked = stored(usable(queries, id_col, vec_col, scale), "queries")
    borders = cell_borders(rows, cells)
    blocks = max(1, -(-rows.count() // block_rows))
    query_blocks = max(1, -(-asked.count() // query_rows))

    def quantise(batches):
        for batch in batches:
            dims = np.asarray(batch.column(2))
            out = [b""] * batch.num_rows
            lists = batch.column(3)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                cell = np.empty((len(at), dim), np.uint8)
                for d in range(dim):
                    cell[:, d] = np.searchsorted(borders[int(dim)][d, 1:-1], values[:, d], "right")
                for i, own in zip(at, cell):
                    out[i] = own.tobytes()
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["vec_id", "row", "dim", "cells"])

    # The approximation file: a byte a dimension instead of eight.
    approx = stored(rows.where("dim > 0").mapInArrow(quantise, "vec_id bigint, row bigint, dim int, cells binary"), "cells")
    part = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    scanned = approx.withColumn("block", part("row", blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asking = asked.where("dim > 0").select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "dim", "v").withColumn(
        "part", part("query_row", query_blocks)
    ).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kept_type = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("row", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def bound(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kept_type.empty_table()
        dim = key[0].as_py()
        cell = np.frombuffer(b"".join(left.column("cells").to_pylist()), np.uint8).reshape(-1, dim)
        edges = borders[dim]
        at = np.arange(dim)
        low_edge, high_edge = edges[at, cell], edges[at, cell + np.int64(1)]
        q = right.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        high = up @ high_edge.T + down @ low_edge.T
        low = up @ low_edge.T + down @ high_edge.T
        own = right.column("query_id").to_numpy()[:, None] == left.column("vec_id").to_numpy()[None, :]
        low[own] = high[own] = -np.inf
        least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(q), -np.inf)
        i, j = np.nonzero((high >= least[:, None]) & ~own)
        return pa.table([right.column("query_id").take(pa.array(i)), right.column("query_row").take(pa.array(i)), left.column("row").take(pa.array(j)), pa.array(low[i, j]), pa.array(high[i, j])], schema=kept_type)

    keys = ("dim", "block", "part")
    bounded = stored(
        scanned.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(bound, "query_id bigint, query_row bigint, row bigint, low double, high double"),
        "bounds",
    )
    # The kth largest lower bound over all blocks; -inf while there are fewer than k.
    order = Window.partitionBy("query_row").orderBy(F.desc("low"))
    sure = bounded.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy("query_row").agg(
        F.when(F.count("*") == k, F.min("low")).otherwise(F.lit(float("-inf"))).alias("least")
    )
    near = bounded.join(sure, "query_row").where("high >= least").select("query_row", "row")
    exact = near.join(rows.select("row", "vec_id", "v"), "row").join(
        asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_row"
    )
    product = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x)
    scored = exact.select("query_id", "query_row", "vec_id", "row", product.alias("score"))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
