"""Token counts of documents from flat token files: nothing but ids, and an end id after every document.

The files have no index. They are cut into blocks of ``BLOCK_TOKENS`` ids; a task reads its blocks by byte range,
finds all end ids in one vectorised comparison, and returns the lengths between them. A prefix scan over the
blocks of a file then numbers the documents and adds the open piece of the previous blocks to the first length
of each block, so a document may span any number of blocks and a file may have any size.

Writing: every task writes one file into the shared folder and returns where each document went. Rows of a failed
attempt are never committed, and its file is never named by any row, so a lost executor does no harm. Null and
empty texts are documents of no ids. Strings of special tokens in a text are ordinary text here, so the end id can't
occur inside a document. Repeated rows and ids are documents of their own. An empty table writes no files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polarframe.llm.shared import stored
from polarframe.llm.tokens import encode, encoding

BLOCK_TOKENS = 1 << 20


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def id_type(tokenizer: str) -> str:
    """Two bytes an id where the vocabulary allows, else four."""
    return "<u2" if encoding(tokenizer).n_vocab <= 1 << 16 else "<u4"


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write all texts as flat files under ``folder``; (doc_id, file, ordinal) says where each went."""
    kind = id_type(tokenizer)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _place(folder)
        files.create_dir(base, recursive=True)
        name, at, out = f"tokens-{uuid.uuid4().hex}.bin", 0, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                out = out or files.open_output_stream(f"{base}/{name}")
                for text in batch.column(1):
                    out.write(np.append(encode(tokenizer, text.as_py(), specials=False), np.uint32(end_id)).astype(kind).tobytes())
                n = batch.num_rows
                yield pa.record_batch([batch.column(0), pa.array([name] * n, pa.string()), pa.array(np.arange(at, at + n), pa.int64())], ["doc_id", "file", "ordinal"])
                at += n
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(write, "doc_id bigint, file string, ordinal bigint"), "places")


def scan(spark: SparkSession, names: DataFrame, folder: str, kind: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of all documents in the files ``names`` (column ``file``).

    Ids after the last end id are a last document that is not closed.
    """
    width = np.dtype(kind).itemsize

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _place(folder)
        for batch in batches:
            names, numbers, sizes = [], [], []
            for name in batch.column(0).to_pylist():
                ids = files.get_file_info(f"{base}/{name}").size // width
                for b in range(-(-ids // block_tokens)):
                    names.append(name), numbers.append(b), sizes.append(min(block_tokens, ids - b * block_tokens))
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64())], ["file", "block", "ids"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _place(folder)
        for batch in batches:
            lengths, lasts = [], []
            for name, b, n in zip(*[c.to_pylist() for c in batch.columns]):
                with files.open_input_file(f"{base}/{name}") as f:
                    ids = np.frombuffer(f.read_at(n * width, b * block_tokens * width), kind)
                ends = np.flatnonzero(ids == end_id)
                lengths.append(np.diff(ends, prepend=-1) - 1)
                lasts.append(b * block_tokens + int(ends[-1]) if len(ends) else None)
            yield pa.record_batch([*batch.columns, pa.array(lengths, pa.list_(pa.int64())), pa.array(lasts, pa.int64())], ["file", "block", "ids", "lengths", "last"])

    cut = names.select("file").distinct().mapInArrow(blocks, "file string, block bigint, ids bigint")
    found = cut.repartition("file", "block").mapInArrow(search, "file string, block bigint, ids bigint, lengths array<bigint>, last bigint")
    # The prefix scan: one row a block.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "file", "lengths", F.coalesce(F.sum(F.size("lengths")).over(before), F.lit(0)).alias("offset"),
        (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("opened"), (F.col("block") * block_tokens).alias("begin"),
        "ids", "last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("final"),
    )
    # The open end of a file, if any, is one more document of its last block.
    open_from = F.coalesce(F.col("last") + 1, F.col("opened"))
    rest = F.col("begin") + F.col("ids") - open_from
    first = F.transform("lengths", lambda n, i: F.struct((n + F.when(i == 0, F.col("begin") - F.col("opened")).otherwise(0)).alias("n"), F.lit(True).alias("closed")))
    tail = F.when(F.col("final") & (rest > 0), F.array(F.struct(rest.alias("n"), F.lit(False).alias("closed")))).otherwise(F.array().cast("array<struct<n:bigint,closed:boolean>>"))
    docs = stitched.select("file", "offset", F.posexplode(F.concat(first, tail)).alias("i", "doc"))
    ordinal = (F.col("offset") + F.col("i")).cast("bigint")
    return docs.select("file", ordinal.alias("ordinal"), F.col("doc.n").alias("n_tokens"), F.col("doc.closed").alias("closed"))


def count_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal): documents written flat, then counted from the files alone."""
    places = write_flat(docs, folder, tokenizer, end_id)
    counts = scan(docs.sparkSession, places, folder, id_type(tokenizer), end_id, block_tokens)
    # Names and running numbers compress so well that Spark would take the files for small enough to broadcast.
    return places.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
