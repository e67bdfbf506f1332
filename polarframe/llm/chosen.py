"""Near-duplicate documents by a chosen-path set similarity join.

A text's set are the hashes of its distinct word n-grams (``words``: 64 bits; equal hashes count as equal n-grams). Texts link when
100 * intersection >= percent * union; the result is the connected component of every document.

1. Equal sets become one representative; copies are never expanded.
2. Trees. A node is a path of chosen coordinates and the minwise values that its members have there. At the root and at every
   further node ``BRANCH`` coordinates are drawn by a hash of the path, and each member goes to the child of its value. A pair
   of similarity s stays together in a child with a chance of s, so it is in common nodes at any depth with a chance that does
   not vanish while unlike pairs part: at 0.85 a tree misses 2 to 3 pairs in 100. ``trees_for`` computes how many independent trees bring the miss
   of a pair right at the threshold below 1 - ``recall`` (four by default, which miss one in a million).
3. Only nodes with members of at least two components matter. First each member is held against its node's first one (linear), which joins
   groups of near copies. A node is compared exhaustively once its members outside its largest component times all its members are few, or when a
   branch hardly makes it smaller (its members are like each other, so more branches would not part them), or at ``DEPTH``.
   Other nodes branch on, one round of shuffles per level.
4. Comparing counts the agreement of ``POOL`` minwise bytes, in tiles of bounded size, so no node has to fit a task. A pair of the threshold's
   similarity falls below the least agreement that is looked at with a chance of 10^-7. First the ``BEST`` partners of each member per tile
   are confirmed on the full sets. Then members that still have candidates in another component form clusters by
   them, and each goes to its cluster once with its full set: in tiles of bounded bytes all of those pairs are decided, and only links leave.
   Nothing is capped.

So a link at the threshold is missed with a chance of about one in a million, a closer one with less; what is reported as a link is exact.

Defined results: null and empty texts have no n-grams and are alone (component_id is their own id). Rows with the same
id and text are equal sets. Null ids are kept; component_id is the smallest id that is not null. An empty table gives no rows. Only
the columns doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarframe.llm.jaccard import Forest, set_name, text_sets
from polarframe.llm.shared import components, join_checked, runs, steps, stored
from polarframe.llm.words import mix

BRANCH = 2
POOL = 512
DEPTH = 8
#: Comparisons that a node may take before it branches, and the share of its parent that makes it dense.
WORK = 1 << 18
DENSE = 0.7
#: Members on either side of a tile.
BLOCK, TILE = 512, 2048
#: n-grams on either side of a tile of full sets: eight megabytes.
TILE_GRAMS = 1 << 20
BEST = 4
SKETCH_MISS = 1e-7
#: Bytes of text that are hashed together.
STEP = 1 << 20


def _tail(n: int, p: float) -> np.ndarray:
    """Chances of a binomial variable to be below 0, 1, ..., n + 1."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(n + 1)]
    return np.concatenate([[0.0], np.cumsum(np.exp(logs))])


def least_agreement(percent: int, miss: float = SKETCH_MISS) -> int:
    """Agreeing coordinates that a pair at the threshold reaches but for a chance of ``miss``."""
    return int(np.searchsorted(_tail(POOL, min(percent / 100, 1 - 1e-9)), miss, "right")) - 1


def tree_miss(percent: int, trees: int) -> float:
    """Chance that a pair at the threshold has no common node at the last level of any of ``trees`` trees.

    The root's coordinates are independent; all others come from one pool, so their agreement is averaged over what the pool may hold.
    """
    s = min(percent / 100, 1 - 1e-9)
    weight = np.diff(_tail(POOL, s))
    share = np.arange(POOL + 1) / POOL
    lost = np.zeros(POOL + 1)
    for _ in range(DEPTH - 1):
        lost = (1 - share + share * lost) ** BRANCH
    return float((weight * ((1 - s + s * lost) ** BRANCH) ** trees).sum())


def trees_for(percent: int, recall: float) -> int:
    trees = 1
    while tree_miss(percent, trees) > 1 - recall:
        trees += 1
    return trees


def minima(sets: list[np.ndarray], functions: range) -> np.ndarray:
    """Minwise values, a row per set (none of them empty) and a column per function."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    seeds = mix(np.arange(functions.start, functions.stop, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    factors = mix(seeds) | np.uint64(1)
    out = np.empty((len(sets), len(functions)), np.uint64)
    for j in range(len(functions)):
        out[:, j] = np.minimum.reduceat((values ^ seeds[j]) * factors[j], starts)
    return out


def children(node: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The ``BRANCH`` child nodes of every (node, member): drawn coordinates with the member's values there."""
    drawn = mix(node.view(np.uint64))
    first = drawn % np.uint64(POOL)
    # Different coordinates, so the branches of a node do not repeat each other.
    apart = np.uint64(1) + (drawn >> np.uint64(20)) % np.uint64((POOL - 1) // (BRANCH - 1))
    out = np.empty((len(node), BRANCH), np.uint64)
    for b in range(BRANCH):
        at = (first + np.uint64(b) * apart) % np.uint64(POOL)
        value = sketch[np.arange(len(node)), at.astype(np.int64)].astype(np.uint64)
        out[:, b] = mix(drawn + (at * np.uint64(256) + value + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *[len(r) for r in rows]]).astype(np.int32)
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def names(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """(doc_id, row, n, s1, s2, roots): size and name of every text's set and its nodes at the first level; row numbers are internal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = np.arange(1, trees * BRANCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in steps(batches, "text", STEP):
            sets = text_sets(batch.column(2), width)
            named = np.array([set_name(s) for s in sets], np.int64).reshape(-1, 2)
            roots = [np.zeros(0, np.uint64)] * len(sets)
            filled = [i for i, s in enumerate(sets) if len(s)]
            if filled:
                low = mix(minima([sets[i] for i in filled], range(POOL, POOL + trees * BRANCH)) ^ functions)
                for i, r in zip(filled, low):
                    roots[i] = r
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(named[:, 0]), pa.array(named[:, 1]), _lists(roots)],
                ["doc_id", "row", "n", "s1", "s2", "roots"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(run, "doc_id bigint, row bigint, n bigint, s1 bigint, s2 bigint, roots array<bigint>"), "names")


def member_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(row, n, grams, sketch) of the representatives in ``members`` (row, doc_id, s1, s2), from their texts read once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            row, grams = [], []
            for s, r, s1, s2 in zip(text_sets(batch.column(0), width), *[c.to_pylist() for c in batch.columns[1:]]):
                if len(s) and set_name(s).tolist() == [s1, s2]:
                    row.append(r), grams.append(s)
            if row:
                sketch = (mix(minima(grams, range(POOL))) & np.uint64(255)).astype(np.uint8)
                yield pa.record_batch(
                    [pa.array(row, pa.int64()), pa.array([len(g) for g in grams], pa.int64()), _lists(grams), pa.array([s.tobytes() for s in sketch], pa.binary())],
                    ["row", "n", "grams", "sketch"],
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.col("text").cast("string"))
    own = join_checked(texts, members, F.col("d").eqNullSafe(F.col("doc_id")))
    found = own.select("text", "row", "s1", "s2").mapInArrow(run, "row bigint, n bigint, grams array<bigint>, sketch binary")
    return stored(found, "grams")


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POOL)


def _beside(pairs: DataFrame, sets: DataFrame, value: str) -> DataFrame:
    """(a, b, va, vb): both sides' values of every pair; only values of rows in pairs are moved."""
    side = lambda x: join_checked(sets.select(F.col("row").alias(x), F.col(value).alias(f"v{x}")), pairs, [x])
    return side("a").join(side("b"), ["a", "b"])


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches agree as linked sets do."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_sketches(batch.column(2)) == _sketches(batch.column(3))).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    return _beside(pairs, sets, "sketch").mapInArrow(run, "a bigint, b bigint")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that link, on their full sets."""
    both = F.size(F.array_intersect("va", "vb"))
    union = F.size("va") + F.size("vb") - both
    return stored(_beside(pairs, sets, "grams").where(100 * both >= percent * union).select("a", "b"), "links")


def _mixed(state: DataFrame, comps: DataFrame) -> DataFrame:
    """``state`` (node, row, ...) of nodes with several components: with comp, total, rest (members outside the largest one), largest."""
    own = state.join(comps.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("root", "row")).drop("root")
    own = stored(own, "labelled")
    # Both aggregates combine before they shuffle, so a node of any size costs a row per task and component.
    by = own.groupBy("node", "comp").count().groupBy("node").agg(F.sum("count").alias("total"), F.max(F.struct("count", "comp")).alias("most"))
    stats = by.where("most.count < total").select("node", "total", (F.col("total") - F.col("most.count")).alias("rest"), F.col("most.comp").alias("largest"))
    return stored(join_checked(own, stored(stats, "nodes"), ["node"]), "mixed")


def _branch(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, row, parent): members of the children, with the number of members of the node they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                below = children(np.asarray(batch.column(0)), _sketches(batch.column(3))).ravel()
                again = [pa.array(np.repeat(np.asarray(batch.column(i)), BRANCH)) for i in (1, 2)]
                yield pa.record_batch([pa.array(below), *again], ["node", "row", "parent"])

    rows = mixed.select("node", "row", "total").join(sets.select("row", "sketch"), "row").select("node", "row", "total", "sketch")
    return stored(rows.mapInArrow(run, "node bigint, row bigint, parent bigint"), "state")


def _tiled(mixed: DataFrame, blocks: Column, tiles: Column, columns: list[str]) -> DataFrame:
    """Rows of ``mixed`` in sorted tiles (node, t1, t2): members outside the node's largest component ask (``asks``) all members."""
    rows = mixed.withColumns({"blocks": blocks.cast("int"), "tiles": tiles.cast("int")})
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(c)).cast("int")
    outside = rows.where("comp != largest").withColumn("t1", dealt("blocks", 1)).withColumn("t2", every("tiles")).withColumn("asks", F.lit(True))
    inside = rows.withColumn("t1", every("blocks")).withColumn("t2", dealt("tiles", 2)).withColumn("asks", F.lit(False))
    names = ["node", "t1", "t2", "row", "comp", "n", "asks", "sketch", *columns]
    return outside.select(*names).union(inside.select(*names)).repartition("node", "t1", "t2").sortWithinPartitions("node", "t1", "t2")


def _candidates(tile: pa.Table, percent: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(asking place, asked places, agreement) of every asking member with partners of other components in reach."""
    comp, n, asks = (np.asarray(tile.column(c)) for c in ("comp", "n", "asks"))
    sketch = _sketches(tile.column("sketch"))
    asked = np.flatnonzero(~asks)
    for i in np.flatnonzero(asks).tolist():
        fits = asked[(comp[asked] != comp[i]) & (100 * np.minimum(n[asked], n[i]) >= percent * np.maximum(n[asked], n[i]))]
        same = np.count_nonzero(sketch[fits] == sketch[i], axis=1)
        if (same >= least).any():
            yield i, fits[same >= least], same[same >= least]


def _compare(mixed: DataFrame, sets: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Candidates (a, b) between different components in the nodes of ``mixed``: each member with its ``best`` partners in each tile, or, without
    ``best``, a forest per tile that connects whatever all candidates connect."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, ["node", "t1", "t2"]):
            row, pairs, forest = np.asarray(tile.column("row")), [], Forest(tile.num_rows)
            places = {r: i for i, r in enumerate(row.tolist())}  # a member that asks and is asked has one place
            for i, fits, same in _candidates(tile, percent, least):
                if best is None:
                    own = places[int(row[i])]
                    fits = np.array([j for j in fits.tolist() if forest.join(own, places[int(row[j])])], np.int64)
                else:
                    fits = fits[np.argsort(-same, kind="stable")[:best]]
                pairs.append(np.stack([np.minimum(row[fits], row[i]), np.maximum(row[fits], row[i])], 1))
            if pairs:
                found = np.unique(np.concatenate(pairs), axis=0)
                yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    count = lambda c, size: F.ceil(F.col(c) / size)
    rows = mixed.join(sets.select("row", "n", "sketch"), "row")
    tiles = _tiled(rows, count("rest", BLOCK), count("total", TILE), [])
    return stored(tiles.mapInArrow(run, "a bigint, b bigint").distinct(), "pairs")


def _search(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all links between different components in the clusters of ``mixed``, on the full sets, which meet in tiles of bounded bytes."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, ["node", "t1", "t2"]):
            row, grams = np.asarray(tile.column("row")), tile.column("grams").combine_chunks()
            at, flat = np.asarray(grams.offsets), np.asarray(grams.values).view(np.uint64)
            sets_of = lambda i: flat[at[i] : at[i + 1]]
            found = []
            for i, fits, _ in _candidates(tile, percent, least):
                own = sets_of(i)
                for j in fits.tolist():
                    other = sets_of(j)
                    place = np.searchsorted(other, own)
                    both = int((other[np.minimum(place, len(other) - 1)] == own).sum())
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        found.append((row[i], row[j]))
            if found:
                pairs = np.array(found)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = mixed.join(sets, "row")
    weight = rows.groupBy("node").agg(F.sum("n").alias("w"), F.sum(F.when(F.col("comp") != F.col("largest"), F.col("n"))).alias("v"))
    count = lambda c, size, w: F.greatest(F.ceil(F.col(c) / size), F.ceil(F.col(w) / TILE_GRAMS))
    rows = join_checked(rows, stored(weight, "weights"), ["node"])
    tiles = _tiled(rows, count("rest", TILE, "v"), count("total", TILE, "w"), ["grams"])
    return stored(tiles.mapInArrow(run, "a bigint, b bigint").distinct(), "links")


def _closes(level: int) -> Column:
    """Nodes that are compared now instead of branching."""
    few = F.col("total") * F.col("rest") <= WORK
    return F.lit(True) if level >= DEPTH else few | F.coalesce(F.col("total") >= DENSE * F.col("parent"), F.lit(False))


def links(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): confirmed links that connect the representatives (row, doc_id, s1, s2, roots) of each component."""
    seeds = reps.select("row", F.explode("roots").alias("node"))
    shared = stored(seeds.groupBy("node").agg(F.count("*").alias("c"), F.min("row").alias("first")).where("c > 1"), "shared")
    state = stored(join_checked(seeds, shared.select("node", "first"), ["node"]), "state")
    members = stored(reps.join(state.select("row").distinct(), "row").select("row", "doc_id", "s1", "s2"), "members")
    # A representative's id may stand on other rows too; one of the rows with its set is enough.
    sets = member_sets(docs, members, width)
    if sets.count() > members.count():
        sets = stored(sets.groupBy("row").agg(F.first(F.struct("n", "grams", "sketch")).alias("s")).select("row", "s.*"), "sets")
    star = stored(state.where("first != row").select(F.col("first").alias("a"), F.col("row").alias("b")).distinct(), "star")
    found = confirm(stored(alike(star, sets, percent), "alike"), sets, percent)
    comps = components(found)
    # Down the trees, all at once.
    state, closed, level = state.select("node", "row", F.lit(None).cast("bigint").alias("parent")), None, 1
    while True:
        mixed = _mixed(state, comps)
        if mixed.isEmpty():
            break
        done = mixed.where(_closes(level)).drop("parent")
        closed = done if closed is None else closed.union(done)
        if level >= DEPTH:
            break
        state, level = _branch(mixed.where(~_closes(level)), sets), level + 1
    if closed is None:
        return found
    found = stored(found.union(confirm(_compare(closed, sets, percent, BEST), sets, percent)), "links")
    comps = components(found)
    # Members with candidates in other components meet once more with their full sets, each in one cluster of candidates.
    left = components(_compare(_mixed(closed.select("node", "row"), comps), sets, percent, None)).toDF("row", "node")
    return stored(found.union(_search(_mixed(left, comps), sets, percent)), "links")


def classes(docs: DataFrame, width: int = 5, percent: int = 85, recall: float = 0.99999) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; the copies of a set share its class."""
    rows = names(docs, width, trees_for(percent, recall))
    # Copies meet before the shuffle: the aggregate keeps one row of each set per task.
    reps = rows.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("row", "doc_id")).alias("r"), F.min("doc_id").alias("least"), F.first("roots").alias("roots"))
    reps = stored(reps.select("s1", "s2", "least", "r.*", "roots"), "sets")
    roots = components(links(docs, reps, width, percent)).withColumnRenamed("node", "row")
    named = reps.join(roots, "row", "left").select("s1", "s2", "least", F.coalesce("root", "row").alias("root"))
    by_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = named.join(by_root, "root").select("s1", "s2", "component_id")
    return rows.select("doc_id", "n", "s1", "s2").join(answer, ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
