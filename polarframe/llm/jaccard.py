"""Exact n-gram Jaccard join with count-vector R-trees.

A text's set are the hashes of its distinct word n-grams (``words``: 64 bits; equal hashes count as equal n-grams). Texts link
when 100 * intersection >= percent * union; the result is the connected component of every document.

1. Equal sets become one representative; copies are never expanded.
2. Candidates. Put a set's hashes in order on a circle. Two different linked sets have at least percent / (100 - percent)
   common n-grams for every differing one, so somewhere on their common circle at least that many common n-grams (the
   run) follow each other undisturbed, and do so in both sets. Short sequences of neighbours, of which every run
   holds one by the rule of the smallest hash in a window, are the keys: linked sets always share a key, at a fraction
   of a row per n-gram. Sets that share a key are joined to the first of them, batch by batch before the shuffle, so a
   frequent key has at most a row per batch. The clusters so formed contain whole components; no pairs are listed.
3. Every cluster is searched by itself. Counts of n-grams per group of hashes are points of an R-tree; the overlap of a set
   with anything below a node is at most the sum of the smaller coordinates of its counts and the node's upper corner. Nodes that
   can't reach the threshold, or hold nothing but the query's own component, are skipped; what is left is verified
   on the sets, and a forest of verified links comes out, not all pairs.
4. A cluster of more than ``PART_BYTES`` is cut into parts. Each part is searched together with the first one; then only
   the members outside the largest component meet every part. So one huge group of copies costs about as much as its size.

Defined results: null and empty texts have no n-grams and are alone (component_id is their own id). Rows with the same
id and text are equal sets. Null ids are kept; component_id is the smallest id that is not null. An empty table gives no rows. Only
the columns doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarframe.llm.shared import components, join_checked, runs, steps, stored
from polarframe.llm.words import mix, shingles, words

GROUPS = 32
LEAF = 16
PART_BYTES = 16 << 20
U64 = float(1 << 64)


def text_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text."""
    w = words(column, lower=True)
    return [np.unique(shingles(w.hash[a:b], width)) for a, b in zip(w.first[:-1], w.first[1:])]


def set_name(s: np.ndarray) -> np.ndarray:
    """128-bit name of a set, as two integers."""
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)


def run_length(percent: int) -> int:
    """Common n-grams in a row that any two different linked sets have on the circle of hashes."""
    return -(-percent // (100 - percent))


def circle_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a sorted set: hashes of ``k`` neighbours on the circle, the smallest of every ``w`` following ones.

    Any run of w + k - 1 neighbours holds a key, wherever it lies. A smaller set links with no other set.
    """
    run = run_length(percent)
    n, k = len(s), min(run, max(3, run // 2))
    w = run - k + 1
    if n < run:
        return np.zeros(0, np.uint64)
    circle = np.concatenate([s, s[: k - 1]])
    hashed = circle[:n]
    for i in range(1, k):
        hashed = hashed * np.uint64(0xC2B2AE3D27D4EB4F) + circle[i : n + i]
    hashed = mix(hashed)
    around = np.concatenate([hashed, hashed[: w - 1]])
    low = around[:n]
    for i in range(1, w):
        low = np.minimum(low, around[i : n + i])
    before = np.concatenate([low[n - w + 1 :], low]) if w > 1 else low
    high = before[:n]
    for i in range(1, w):
        high = np.maximum(high, before[i : n + i])
    return hashed[high == hashed]


def names(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, row, n, s1, s2): size and name of every text's set; row numbers are internal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sets = text_sets(batch.column(2), width)
            named = np.array([set_name(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(named[:, 0]), pa.array(named[:, 1])], ["doc_id", "row", "n", "s1", "s2"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(run, "doc_id bigint, row bigint, n bigint, s1 bigint, s2 bigint"), "names")


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key: the first node of each one's key, and whether it is that first row."""
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return node[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))], fresh


def candidate_edges(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): names (first half) of sets that share a key; a stands for the first set known to have it."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sets = text_sets(batch.column(0), width)
            keys = [circle_keys(s, percent) for s in sets]
            node = np.repeat(np.array([set_name(s)[0] for s in sets], np.int64), [len(k) for k in keys])
            key = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            first, fresh = _stars(key, node)
            edges = ~fresh & (node != first)
            a, b = first[edges], node[edges]
            # What the batch has joined already travels under a key of its own, so a frequent key stays small.
            own = mix(mix(a.view(np.uint64)) + b.view(np.uint64)).view(np.int64)
            yield pa.record_batch([pa.array(np.concatenate([key[fresh], own, own])), pa.array(np.concatenate([node[fresh], a, b]))], ["key", "node"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_node = None, None
        for batch in batches:
            key, node = (np.asarray(c) for c in batch.columns)
            if not len(key):
                continue
            first, fresh = _stars(key, node)
            if key[0] == last_key:  # the key began in an earlier batch
                first, fresh = np.where(key == last_key, last_node, first), fresh & (key != last_key)
            last_key, last_node = key[-1], first[-1]
            edges = ~fresh & (node != first)
            pairs = np.unique(np.stack([first[edges], node[edges]], 1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    sent = docs.select(F.col("text").cast("string")).mapInArrow(explode, "key bigint, node bigint")
    return sent.repartition("key").sortWithinPartitions("key", "node").mapInArrow(join, "a bigint, b bigint").distinct()


class Forest:
    """Union by smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class CountTree:
    """R-tree over count vectors, packed by splitting along the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, forest: Forest, percent: int):
        self.points, self.sizes, self.forest, self.percent = points, sizes, forest, percent
        self.top = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> list:
        p, n = self.points[rows], self.sizes[rows]
        node = [p.max(0), int(n.min()), int(n.max()), rows, None, False]
        if len(rows) > LEAF:
            spread = p.max(0) - p.min(0)
            by = n if n.max() - n.min() > spread.max() else p[:, int(np.argmax(spread))]
            order = np.argsort(by, kind="stable")
            half = len(rows) // 2
            node[4] = (self._build(rows[order[:half]]), self._build(rows[order[half:]]))
        return node

    def _reaches(self, overlap, n: int, m) -> bool:
        # 100 * o >= percent * (n + m - o)
        return overlap * (100 + self.percent) >= self.percent * (n + m)

    def near(self, i: int) -> Iterator[int]:
        """Points that may link with point ``i`` and are in another component when they come up."""
        q, n, find = self.points[i], int(self.sizes[i]), self.forest.find
        stack = [(self.top, False)]
        while stack:
            node, leaving = stack.pop()
            upper, least, most, rows, below, uniform = node
            if leaving:
                node[5] = below[0][5] and below[1][5] and find(int(below[0][3][0])) == find(int(below[1][3][0]))
                continue
            if uniform and find(int(rows[0])) == find(i):
                continue
            if most * 100 < n * self.percent or n * 100 < least * self.percent:
                continue
            if not self._reaches(int(np.minimum(q, upper).sum()), n, least):
                continue
            if below is not None:
                if not uniform:
                    stack.append((node, True))
                stack += [(below[0], False), (below[1], False)]
                continue
            overlap = np.minimum(q, self.points[rows]).sum(1)
            fits = rows[self._reaches(overlap, n, self.sizes[rows])]
            for j in fits.tolist():
                if j != i and find(j) != find(i):
                    yield j
            if not uniform:
                roots = {find(j) for j in rows.tolist()}
                node[5] = len(roots) == 1


def verified_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of exact links that connects the same sets as all links between them."""
    sizes = np.array([len(s) for s in sets])
    borders = (np.arange(1, GROUPS) * (U64 / GROUPS)).astype(np.uint64)
    points = np.array([np.diff(np.searchsorted(s, borders), prepend=0, append=len(s)) for s in sets])
    forest = Forest(len(sets))
    tree = CountTree(points, sizes, forest, percent)
    links = []
    for i in range(len(sets)):
        for j in tree.near(i):
            small, large = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if 100 * both >= percent * (len(small) + len(large) - both) and forest.join(i, j):
                links.append((i, j))
    return links


def _search(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b) verified links in every tile; ``tiles``: (cluster, t1, t2, row, n, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, ["cluster", "t1", "t2"]):
            row = np.asarray(tile.column("row"))
            links = verified_links([np.frombuffer(g, np.uint64) for g in tile.column("grams").to_pylist()], percent)
            if links:
                at = np.array(links)
                yield pa.record_batch([pa.array(row[at[:, 0]]), pa.array(row[at[:, 1]])], ["a", "b"])

    keys = ["cluster", "t1", "t2"]
    return tiles.select(*keys, "row", "grams").repartition(*keys).sortWithinPartitions(*keys, "row").mapInArrow(run, "a bigint, b bigint")


def member_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(cluster, row, n, grams) of the representatives in ``members``, from their texts read once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            row, cluster, grams = [], [], []
            for k, r, c, s1, s2 in zip(text_sets(batch.column(0), width), *[x.to_pylist() for x in batch.columns[1:]]):
                if set_name(k).tolist() == [s1, s2]:
                    row.append(r), cluster.append(c), grams.append(k.tobytes())
            yield pa.record_batch([pa.array(row, pa.int64()), pa.array(cluster, pa.int64()), pa.array([len(g) // 8 for g in grams], pa.int64()), pa.array(grams, pa.binary())], ["row", "cluster", "n", "grams"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.col("text").cast("string"))
    own = join_checked(texts, members, F.col("d").eqNullSafe(F.col("doc_id")))
    return own.select("text", "row", "cluster", "s1", "s2").mapInArrow(run, "row bigint, cluster bigint, n bigint, grams binary")


def classes(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; the copies of a set share its class."""
    rows = names(docs, width)
    # Copies meet before the shuffle: the aggregate keeps one row of each set per task.
    reps = stored(rows.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("row", "doc_id")).alias("r"), F.min("doc_id").alias("least")).select("s1", "s2", "least", "r.*"), "sets")
    clusters = components(candidate_edges(docs, width, percent))
    members = stored(reps.join(clusters.select(F.col("node").alias("s1"), F.col("root").alias("cluster")), "s1"), "members")
    # A representative's id may stand on other rows too; one of the rows with its set is enough.
    found = member_sets(docs, members, width).groupBy("row").agg(F.first(F.struct("cluster", "n", "grams")).alias("m")).select("row", "m.*")
    sets = stored(found, "grams")
    parts = sets.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") * 8) / PART_BYTES).cast("int").alias("parts"))
    own_part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    placed = join_checked(sets, parts, ["cluster"]).withColumn("part", own_part)
    # Each part with the first one; the first by itself if it is the only one.
    others = F.when(F.col("part") > 0, F.array(F.col("part"))).when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("parts") - 1))
    links = stored(_search(placed.withColumn("t1", F.lit(0)).withColumn("t2", F.explode(others)), percent), "links")
    large = parts.where("parts > 1")
    if not large.isEmpty():
        links = stored(links.union(_rest(placed.where("parts > 1"), components(links), percent)), "links")
    roots = components(links).withColumnRenamed("node", "row")
    named = reps.join(roots, "row", "left").select("s1", "s2", "least", F.coalesce("root", "row").alias("root"))
    by_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = named.join(by_root, "root").select("s1", "s2", "component_id")
    return rows.select("doc_id", "n", "s1", "s2").join(answer, ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _rest(placed: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links of clusters in several parts between the members outside the largest component and every part."""
    known = placed.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    known = stored(known.select("cluster", "row", "n", "grams", "part", "parts", "root"), "parts")
    counts = known.groupBy("cluster", "root").agg(F.count("*").alias("c"))
    largest = counts.groupBy("cluster").agg(F.max_by("root", F.struct("c", "root")).alias("largest"))
    marked = join_checked(known, largest, ["cluster"])
    outside = marked.where("root != largest")
    blocks = outside.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") * 8) / PART_BYTES).cast("int").alias("blocks"))
    asking = join_checked(outside, blocks, ["cluster"]).withColumn("t1", F.pmod(F.xxhash64(F.lit("rest"), "row"), F.col("blocks")).cast("int"))
    asking = asking.withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = join_checked(marked, blocks, ["cluster"]).withColumn("t1", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("t2", F.col("part"))
    columns = ["cluster", "t1", "t2", "row", "n", "grams"]
    # A member may be on both sides of a tile; twice the same set is one more verified link to itself, so it goes once.
    both = asking.select(*columns).union(asked.select(*columns)).dropDuplicates(["cluster", "t1", "t2", "row"])
    return _search(both, percent)
