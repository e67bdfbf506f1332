"""Fill-in-middle transformation by rotations in place.

A text is cut at two line ends into prefix, middle and suffix; a model that sees the first and the last learns to write the
middle. The cuts come from a hash of the seed and the document's id, so a retried task cuts alike. Per text:

1. Scan: the byte offsets behind every newline are the ends of its units.
2. The bytes go into one bytearray, and three sentinels are inserted from the back: ``<P>`` prefix ``<M>`` middle ``<S>`` suffix.
3. Two neighbouring blocks change places by three reversals, each block by itself and then both together: the last two blocks for the
   form ``psm``, the first two together with the last one for ``spm``. No block is copied out, memory stays a small multiple of one text.
4. Restoring finds the sentinels, rotates back by the same rule with the lengths exchanged, and deletes them from the back.

Cuts lie behind newlines, where no UTF-8 character and no sentinel can be split, so the sentinels of a text that holds none are
found again at their places.

Defined results: a null text counts as empty; an empty text, one that holds a sentinel and one that the rate leaves out stay
as they are (form ``plain``). A text of one unit has cuts too, with empty parts. A null id hashes as an empty string. Rows with the same id and
text give the same result each. An empty table gives no rows. Extra columns pass through unless their names clash with an output column: those are
dropped first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarframe.llm.shared import steps

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of text that leave together, twice as long with both results.
STEP = 1 << 20
OUTPUT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string"


class Cut(NamedTuple):
    """Bytes before the middle and before the suffix, and the number of units."""

    low: int
    high: int
    units: int


def rotate(block: bytearray, at: int, middle: int, end: int) -> None:
    """Exchange ``block[at:middle]`` and ``block[middle:end]`` in place by three reversals."""
    for a, b in ((at, middle), (middle, end), (at, end)):
        view = np.frombuffer(block, np.uint8)[a:b]
        half = len(view) // 2
        front = view[:half].copy()
        view[:half] = view[::-1][:half]
        view[len(view) - half :] = front[::-1]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers that depend on seed and id only."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def scan(data: bytes, first: int, second: int) -> Cut:
    """Cuts after ``first`` and ``second`` units, each modulo the number of possible cuts, in order."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    units = len(ends) + (len(data) > (ends[-1] if len(ends) else 0))
    place = lambda k: 0 if k == 0 else int(ends[k - 1]) if k <= len(ends) else len(data)
    low, high = sorted((first % (units + 1), second % (units + 1)))
    return Cut(place(low), place(high), units)


def transform(data: bytes, cut: Cut, form: str) -> bytearray:
    """The text with sentinels, its blocks in the order of ``form`` (``psm`` or ``spm``)."""
    out = bytearray(data)
    out[cut.high : cut.high] = SUFFIX
    out[cut.low : cut.low] = MIDDLE
    out[0:0] = PREFIX
    middle = cut.low + len(PREFIX)
    suffix = cut.high + len(PREFIX) + len(MIDDLE)
    if form == "psm":
        rotate(out, middle, suffix, len(out))
    else:  # The suffix comes to the front, prefix and middle stay neighbours.
        rotate(out, 0, suffix, len(out))
    return out


def restore(output: bytes, form: str) -> bytearray:
    """The text that ``transform`` was given, from its result and form alone."""
    out = bytearray(output)
    if form == "plain":
        return out
    moved = out.index(SUFFIX)
    rest = out.index(MIDDLE if form == "psm" else PREFIX, moved)
    # The block that starts at the suffix's sentinel ends at ``rest``; it goes back behind what follows it.
    rotate(out, moved, rest, len(out))
    for mark in (SUFFIX, MIDDLE):
        at = out.rindex(mark)
        del out[at : at + len(mark)]
    del out[: len(PREFIX)]
    return out


def _chars(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all bytes that do not continue one."""
    return int(((data & 0xC0) != 0x80).sum())


def one(text: bytes, doc_id: int | None, seed: int, rate: int, spm_rate: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output, restored) of one text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    cut = scan(text, h1, h2)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return cut.units, "plain", None, None, text, bytes(restore(text, "plain"))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    output = bytes(transform(text, cut, form))
    data = np.frombuffer(text, np.uint8)
    return cut.units, form, _chars(data[: cut.low]), _chars(data[cut.low : cut.high]), output, bytes(restore(output, form))


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without ``text``, with (n, form, prefix_chars, middle_chars, output, restored) of every text.

    ``rate`` percent of the texts are transformed, ``spm_rate`` percent of those into the form with the suffix first.
    """
    names = {part.split()[0] for part in OUTPUT.split(", ")}
    extra = [c for c in docs.columns if c not in names | {text}]
    rows = docs.select(*extra, F.col(key).cast("bigint").alias("_key"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "_text", STEP):
            texts, ids = batch.column(len(extra) + 1).cast(pa.binary()).to_pylist(), batch.column(len(extra)).to_pylist()
            done = [one(t or b"", i, seed, rate, spm_rate) for t, i in zip(texts, ids)]
            columns = list(zip(*done))
            numbers = [pa.array(columns[i], pa.int64()) for i in (0, 2, 3)]
            strings = [pa.array(columns[i], pa.binary()).cast(pa.string()) for i in (4, 5)]
            yield pa.record_batch(
                [*batch.columns[: len(extra)], numbers[0], pa.array(columns[1], pa.string()), *numbers[1:], *strings],
                [*extra, "n", "form", "prefix_chars", "middle_chars", "output", "restored"],
            )

    kept = rows.select(*extra).schema
    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields], OUTPUT]))
