"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they lie; only small rows (place, length and checksum of a piece) move. They are
dealt by a hash into groups of about ``GROUP_ROWS`` pieces, and every group is packed by itself: longest piece first,
into the open bin with the least sufficient room, found in logarithmic time by a segment tree over remaining
capacities. A group leaves a handful of bins partly filled, so the loss against one global run is a few sequences in
tens of thousands of pieces, at any size.

A document is its ids followed by the end id; only a longer one is cut, so that all its pieces but the first are
full. Null and empty texts are a single end id. Repeated rows are packed like any others. An empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarframe.llm.shared import runs, stored
from polarframe.llm.tokens import encode

GROUP_ROWS = 50_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Capacities:
    """Open bins by remaining capacity; inner nodes of the segment tree count the bins below them."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.counts = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.counts[node] += by
            node >>= 1

    def put(self, capacity: int, which: int) -> None:
        self.bins[capacity].append(which)
        self._add(capacity, 1)

    def tightest(self, need: int) -> int | None:
        """The least capacity of an open bin that is at least ``need``."""
        counts, node = self.counts, need + self.size
        if counts[node]:
            return need
        while node > 1:  # up to the first subtree on the right that has a bin, then down its left edge
            if not node & 1 and counts[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if counts[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.bins[capacity].pop()


def best_fit(lengths: list[int], most: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every length; ``lengths`` must not increase."""
    room, bins, offsets, n = Capacities(most), [], [], 0
    for length in lengths:
        capacity = room.tightest(length)
        if capacity is None:
            capacity, which, n = most, n, n + 1
        else:
            which = room.take(capacity)
        bins.append(which)
        offsets.append(most - capacity)
        if capacity > length:
            room.put(capacity - length, which)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, most: int, end_id: int) -> DataFrame:
    """Every document's pieces in order: their start among its ids, length and checksum."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(tokenizer, text.as_py()), np.uint32(end_id)).astype("<u4")
                head = (len(ids) - 1) % most + 1
                starts = [0, *range(head, len(ids), most)]
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    for column, value in zip(out, (doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), *[pa.int64()] * 3))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` with sequence_id and offset; a sequence's pieces lie without gaps from offset 0."""
    cut = stored(pieces(docs, tokenizer, most, end_id), "pieces")
    groups = max(1, -(-cut.count() // group_rows))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["_group"]):
            bins, offsets = best_fit(group.column("length").to_pylist(), most)
            first = group.column("_group")[0].as_py() << 32
            group = group.drop_columns(["_group"])
            group = group.append_column("sequence_id", pa.array([first + b for b in bins], pa.int64()))
            yield from group.append_column("offset", pa.array(offsets, pa.int64())).combine_chunks().to_batches()

    ordered = dealt.repartition(groups, "_group").sortWithinPartitions("_group", F.desc("length"), "doc_id", "piece")
    return ordered.mapInArrow(fill, PIECES + ", sequence_id bigint, offset bigint")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence, from documents with distinct ids and their packing."""

    def slice_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, start, length = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "start", "length"))
            ids = []
            for t, a, n in zip(text, start.to_pylist(), length.to_pylist()):
                ids.append(np.append(encode(tokenizer, t.as_py()), np.uint32(end_id))[a : a + n].astype(np.int32))
            yield pa.record_batch([batch.column(batch.schema.get_field_index("sequence_id")), batch.column(batch.schema.get_field_index("offset")), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    parts = packed.join(docs.select("doc_id", F.col("text")), F.expr("true") & packed.doc_id.eqNullSafe(docs.doc_id)).drop(docs.doc_id)
    sliced = parts.mapInArrow(slice_ids, "sequence_id bigint, offset bigint, ids array<int>")
    # A group is one sequence: at most ``most`` ids.
    joined = sliced.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return joined.select("sequence_id", F.flatten("parts.ids").alias("ids"))
