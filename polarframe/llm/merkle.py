"""Merkle manifest of a data set as a persistent tree that is changed by path copying.

Every row is a leaf; a source's leaves in the order of their ids form a tree whose runs of ``ARITY`` neighbours are
hashed together until one node (the subroot) is left; the subroots of the sources in the order of their names form the tree above, with
the root. The last run of a level may be short, even of one node, which is hashed as well.

How it is spread. A level's nodes are cut into aligned blocks of ``ARITY ** DEPTH`` neighbours. Up to its height, nothing in a block depends on
another block, so each is built by itself (``Block``), and only its root goes on, as a leaf of the next round of blocks: a
source of any size is spread over blocks, and a round has one row where the one before had ``ARITY ** DEPTH``. On the way
back every block gets the path from its root to the tree's root: one row per block, so a leaf's proof is its path inside the block and the
block's path.

Versions. A tampered leaf makes a version of the tree. The version shares every node with the original but the ancestors of that
leaf, which are copied: first inside the leaf's block, then, where the block lies, along the block's path through the upper levels. All
versions are independent, so none waits for another and no upper block meets all of them.

Defined results: ids ascend with null first; rows with the same id are ordered by their leaf's digest, so the tree does not depend on the order of
rows, and equal rows have equal leaves at neighbouring places. A null source is a source of its own, the first. Empty texts have the
length 0, unlike null ones. A row with a null id is never tampered with by ``newlines_cut``. An empty table has no leaves, hence no
rows and no root. Only ``doc_id``, ``source`` and the leaf's columns are read; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polarframe.llm.shared import join_checked, runs, stored

#: Nodes hashed together, and the columns of a leaf in their order.
ARITY = 3
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]
#: Levels of a block: 3 ** 7 = 2,187 leaves.
DEPTH = 7


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Block:
    """Up to ``ARITY ** levels`` neighbouring nodes and their tree of the given number of levels.

    The nodes of a level are kept once. A version of a changed leaf is ``climb`` along the leaf's path: the nodes it returns are
    copies, all others are shared with the block.
    """

    def __init__(self, leaves: list[str], levels: int):
        self.levels = [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[tuple[str, str]]:
        """(left siblings, right siblings) of the leaf and of its ancestors below the root, joined."""
        out = []
        for level in self.levels[:-1]:
            run = at - at % ARITY
            out.append(("".join(level[run:at]), "".join(level[at + 1 : run + ARITY])))
            at //= ARITY
        return out


def climb(node: str, path: list[tuple[str, str]]) -> list[str]:
    """Copies of ``node``'s ancestors along a path of shared siblings."""
    copies = [node]
    for left, right in path:
        copies.append(digest(left + copies[-1] + right))
    return copies


def spelled(path: list[tuple[str, str]]) -> str:
    return "|".join(f"{a},{b}" for a, b in path)


def unspelled(path: str) -> list[tuple[str, str]]:
    return [tuple(step.split(",")) for step in path.split("|")] if path else []


def leaf_of(columns: list[Column]) -> Column:
    """Digest of a row: every value with its length in bytes in front, null as ``-``."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in columns]), 256)


def newlines_cut(doc_id: Column, text: Column) -> Column:
    """The tampered text: without newlines where 2 divides the checksum of the id, else null for untouched."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.translate(text, "\n", ""))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered) of every row; ``tampered`` is null where nothing was changed."""
    columns = [F.col(c) for c in LEAF]
    cut = newlines_cut(F.col("doc_id"), F.col("text"))
    again = leaf_of([cut if c == "text" else F.col(c) for c in LEAF])
    changed = F.when(cut.isNotNull() & F.contains("text", F.lit("\n")), again)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string").alias("source"), leaf_of(columns).alias("leaf"), changed.alias("tampered"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows with ``tree`` (number of the source) and ``at`` (place among the source's leaves, from 0).

    The rows are ranged by source, id and leaf into slices; a row's place is its place in the slice plus the rows of its source in the
    slices before. One row per slice and source is all that is gathered.
    """
    order = ["source", "doc_id", "leaf"]
    sliced = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"_slice": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}),
        "slices",
    )
    counts = stored(sliced.groupBy("source", "_slice").agg(F.count("*").alias("n"), F.min("_row").alias("first")), "counts")
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    names = stored(counts.groupBy("source").agg(F.sum("n").alias("leaves")), "sources")
    trees = _ranked(names, "source").withColumnRenamed("rank", "tree")
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    starts = starts.join(trees.select(F.col("source").alias("_s"), "tree", "leaves"), F.col("source").eqNullSafe(F.col("_s")))
    starts = stored(starts.select("_s", F.col("_slice").alias("_t"), "start", "tree", "leaves"), "starts")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_t"))
    return join_checked(sliced, starts, same).withColumn("at", F.col("_row") + F.col("start")).drop("_s", "_t", "_slice", "_row", "start")


def _ranked(names: DataFrame, by: str) -> DataFrame:
    """``rank`` of distinct values, from 0, null first, by ranges and offsets like the leaves."""
    sliced = stored(
        names.repartitionByRange(by).sortWithinPartitions(by)
        .withColumns({"_slice": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}),
        "ranks",
    )
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("n"))
    earlier = counts.select(F.col("_slice").alias("_before"), "n")
    # One row per slice: at most the number of shuffle partitions.
    starts = counts.select("_slice").join(F.broadcast(earlier), F.col("_before") < F.col("_slice"), "left")
    starts = starts.groupBy("_slice").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("start"))
    return sliced.join(F.broadcast(starts), "_slice").withColumn("rank", F.col("_row") + F.col("start")).drop("_slice", "_row", "start")


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def block_roots(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(tree, at, leaves, node) of the blocks' roots; ``nodes``: (tree, at, leaves, node), ``leaves`` the tree's number of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["tree", "block"]):
            n = block.column("leaves")[0].as_py()
            root = Block(block.column("node").to_pylist(), min(depth, height(n))).root
            yield pa.record_batch([
                pa.array([block.column("tree")[0].as_py()], pa.int64()), pa.array([block.column("block")[0].as_py()], pa.int64()),
                pa.array([-(-n // ARITY**depth)], pa.int64()), pa.array([root]),
            ], ["tree", "at", "leaves", "node"])

    return _by_block(nodes.select("tree", "at", "leaves", "node"), depth).mapInArrow(run, "tree bigint, at bigint, leaves bigint, node string")


def _by_block(nodes: DataFrame, depth: int) -> DataFrame:
    block = F.floor(F.col("at") / ARITY**depth).cast("bigint")
    return nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def paths(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(tree, at, path, top): every node's path to the root of its tree and that root.

    Rounds of blocks upwards until every tree has one node, then back: a block's nodes get their path in the block and the block's own.
    """
    rounds = [nodes]
    while not rounds[-1].where("leaves > 1").isEmpty():
        # Trees that are done pass on, at no cost but their one row.
        rounds.append(stored(block_roots(rounds[-1], depth), "roots"))
    upper = rounds[-1].select("tree", "at", F.lit("").alias("path"), F.col("node").alias("top"))
    for below in reversed(rounds[:-1]):
        upper = stored(_descend(below, upper, depth), "paths")
    return upper


def _descend(below: DataFrame, upper: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, above, top, block in _opened(batches, depth):
            own = [spelled(tree.path(i)) for i in range(block.num_rows)]
            whole = ["|".join(filter(None, (p, above))) for p in own]
            columns = [block.column("tree"), block.column("at"), pa.array(whole, pa.string()), pa.array([top] * len(own), pa.string())]
            yield from pa.table(columns, ["tree", "at", "path", "top"]).combine_chunks().to_batches()

    rows = _with_path(below.select("tree", "at", "leaves", "node"), upper, depth)
    return rows.mapInArrow(run, "tree bigint, at bigint, path string, top string")


def _with_path(nodes: DataFrame, upper: DataFrame, depth: int) -> DataFrame:
    """Blocks of nodes in order, in front of each a row (``at`` is -1) with the block's path and the tree's root: one exchange, no join."""
    block = F.floor(F.col("at") / ARITY**depth).cast("bigint")
    own = upper.select("tree", F.col("at").alias("block"), F.lit(-1).cast("bigint").alias("at"), "path", "top")
    rows = nodes.withColumn("block", block).unionByName(own, allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _opened(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[Block, str, str, pa.Table]]:
    """(tree, path, top, rows) of every block of ``_with_path``."""
    for rows in runs(batches, ["tree", "block"]):
        block = rows.slice(1)
        tree = Block(block.column("node").to_pylist(), min(depth, height(block.column("leaves")[0].as_py())))
        yield tree, rows.column("path")[0].as_py(), rows.column("top")[0].as_py(), block


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof, copied, folded_root) of every row.

    ``proof`` holds the siblings' digests from the leaf up to the root, ``copied`` the nodes of the row's version: its tampered leaf and
    the copies of the ancestors, up to the version's root (null where nothing was tampered with). ``folded_root`` is that root, or the one
    recomputed from the leaf and its proof.
    """
    rows = stored(placed(leaves(docs)), "leaves")
    nodes = rows.select("tree", "at", "leaves", F.col("leaf").alias("node"))
    # The upper levels of every source, then the tree over the subroots.
    upper = paths(stored(block_roots(nodes, depth), "roots"), depth)
    subroots = stored(upper.where("at = 0").select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.col("top").alias("node")), "subroots")
    over = paths(subroots.withColumn("leaves", F.lit(subroots.count()).cast("bigint")), depth)
    over = over.select(F.col("at").alias("tree"), F.col("path").alias("over"), F.col("top").alias("root"))
    whole = upper.join(over, "tree").select("tree", "at", F.concat_ws("/", "path", "over").alias("path"), F.concat_ws(",", "top", "root").alias("top"))
    kept = ["doc_id", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, above, tops, block in _opened(batches, depth):
            subroot, root = tops.split(",")
            above = [step for part in above.split("/") for step in unspelled(part)]
            proofs, copied, folded = [], [], []
            for i, changed in enumerate(block.column("tampered").to_pylist()):
                path = tree.path(i) + above
                proofs.append("".join(a + b for a, b in path))
                # The version starts from the changed leaf; its copies in the upper levels are made here too.
                version = climb(tree.levels[0][i] if changed is None else changed, path)
                copied.append(None if changed is None else version)
                folded.append(version[-1])
            same = lambda v: pa.array([v] * block.num_rows, pa.string())
            columns = [*[block.column(c) for c in [*kept, "node"]], same(subroot), same(root), pa.array(proofs, pa.string()), pa.array(copied, pa.list_(pa.string())), pa.array(folded, pa.string())]
            yield from pa.table(columns, [*kept, "leaf", "subroot", "root", "proof", "copied", "folded_root"]).combine_chunks().to_batches()

    rows = _with_path(rows.withColumnRenamed("leaf", "node").select("tree", "at", "leaves", *kept, "node", "tampered"), whole, depth)
    return rows.mapInArrow(run, "doc_id bigint, source string, leaf string, subroot string, root string, proof string, copied array<string>, folded_root string")
