"""Near-duplicate passages by compact windows over min-hashes.

A text is the sequence of its word five-grams (``WIDTH``). For one hash function, a compact window (left, centre, right) says
that every run of n-grams inside it that contains the centre has the centre's hash as its minimum: the nodes of the
Cartesian tree over the hashes. Only nodes of at least ``least_words`` words matter, about two per that many words and
function. Runs that are the same passage have the same minimum under every function, so both texts have a window with
that hash around it, whatever surrounds the passage.

1. Windows of ``FUNCTIONS`` functions, keyed by function and minimum. Windows with a key are joined to the first of
   them (smallest document, then place), batch by batch before the shuffle, so a passage that a third of all documents
   share is never gathered or paired; every later window gets one earlier partner.
2. Interval join: the hits of a document with one earlier document overlap, where they agree on a passage, in both
   texts and at about the same shift. Where at least ``ENOUGH`` functions agree, the covered range is a candidate.
3. Verification on the words of both ranges, cut out of the texts by byte offsets: maximal runs of the later range whose n-grams
   are in the earlier one, bridged while at least 80 percent match. A passage of at least ``least_words`` words and
   Jaccard similarity of at least ``SIMILAR`` is reported, in bytes and words of the later text.
4. Windows whose centre lies in no passage so far go on to all other partners. One byte a word turns away those that can't share enough with any
   window of their key; the words of the others
   within a shortest passage's reach of their centres are gathered by key, and each is held against the earlier ones that can share enough n-grams (prefix
   filter: rarest n-grams of the key first, so a frequent line proposes nothing), in order, until one is similar.

For passages at the least similarity, no function agrees with a chance of 0.2 ** 6, one in 15,600; all others are found by step 4
at the latest. A passage is reported with one source at least; it may be longer with another one. The first occurrence is never reported. Repeats within one document are
not: passages repeat across documents. Null and empty texts and texts under ``least_words`` words have no passages. Rows with a
null id can't be named, so they take no part and stay as they are. Rows that repeat an id count as one document; a passage is cut
from those rows that have it. An empty table gives no rows. ``find`` reads doc_id and text only; ``remove`` keeps all columns.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarframe.llm.shared import steps, stored, whole_groups
from polarframe.llm.words import mix, shingles, words

WIDTH = 5
FUNCTIONS = 6
ENOUGH = 2
SIMILAR = 0.8
#: Of two similar sets without repeated n-grams, one at least has so large a share in common with the other: each of both sets may have
#: others, but together no more than the similarity allows.
CLOSER = 2 * SIMILAR / (1 + SIMILAR)
#: Passages that repeat across documents are of at least this many words.
LEAST_WORDS = 50
#: Groups of at most so many texts are compared many at a time, all their pairs at once: about so many pairs of n-grams.
SMALL = 64
PAIRS = 1 << 20
#: Of each text's pairs so many are tried at first, and so many at a time in larger groups.
FIRST = 3
AT_ONCE = 16
#: Bytes by which the shift between two texts may drift from one window to the next.
DRIFT = 8 * LEAST_WORDS
# The function is in the last three bits of the key; the centre holds its byte offset and, in the last 32 bits, its word. ``wide`` holds how many
# bytes before and after the centre the window reaches, in 32 bits each; ``near`` the same for the shortest passages around the centre inside the window.
COLUMNS = ["key", "row", "c", "wide", "near", "o_row", "o_c", "o_wide", "o_near"]
SCHEMA = ", ".join(f"{c} bigint" for c in COLUMNS)
# Nearly all windows meet no other one; for the way to the first of their key all columns after ``row`` are one value of big-endian
# integers, which sorts as they do: three of a window by itself, seven of a joined one.
SENT = ["key", "row", "window"]
ALONE, JOINED = 3, 7


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` values, by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return out if span == width else pick(out[: len(x) - width + 1], out[width - span :])


def compact_windows(hashes: np.ndarray, least: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of the Cartesian tree nodes that span at least ``least`` places of one text.

    ``first[d] : first[d + 1]`` are the places of text ``d``. Of equal hashes the first counts as smaller. A node's
    nearest smaller places on both sides are nodes of that span themselves, so only places that are the minimum of
    some run of ``least`` places enter the tree: where the largest of the run minima around them is their own hash.
    """
    none = np.zeros(0, np.int64)
    n = len(hashes)
    if n < least:
        return none, none, none
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = sliding(hashes, least, np.minimum)
    low[text[: n - least + 1] != text[least - 1 :]] = 0
    edge = np.zeros(least - 1, np.uint64)
    centres = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), least, np.maximum) == hashes)
    values, own, begin, end = hashes[centres], text[centres], first[:-1], first[1:] - 1
    edges = np.concatenate([[-1], own, [-1]])  # one place for both ends, -1 and n: no text's own
    number = np.arange(len(centres))

    def nearest(step: int, larger) -> np.ndarray:
        """The next centre on one side that is not larger, by jumps of all at once: those jumped over are larger than it, so than all."""
        to = number + step
        open_ = number
        while len(open_):
            open_ = open_[edges[to[open_] + 1] == own[open_]]
            open_ = open_[larger(values[to[open_]], values[open_])]
            to[open_] = to[to[open_]]
        return to

    before, after = nearest(-1, np.greater), nearest(1, np.greater_equal)
    l = np.where(edges[before + 1] == own, centres[np.maximum(before, 0)] + 1, begin[own])
    r = np.where(edges[after + 1] == own, centres[np.minimum(after, len(centres) - 1)] - 1, end[own])
    wide = r - l + 1 >= least
    return l[wide], centres[wide], r[wide]


def text_grams(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of all texts of a batch in order, their first word, and where each text's n-grams begin."""
    count = np.maximum(np.diff(w.first) - WIDTH + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], count)
    return (shingles(w.hash, WIDTH)[at] if len(at) else np.zeros(0, np.uint64)), at, first


def _joined(key: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Index of the first row of each row's key, for rows sorted by key."""
    return np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))


def _windows(docs: DataFrame, least_words: int) -> DataFrame:
    """Rows for the shuffle (``SENT``): a key's first window in its batch, or a window joined to it."""
    least = least_words - WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        for batch in steps(batches, "text"):
            w = words(batch.column(1))
            grams, at, first = text_grams(w)
            text = np.repeat(np.arange(batch.num_rows), np.diff(first))
            rows = np.asarray(batch.column(0))[text]
            parts = []
            for f in range(FUNCTIONS):
                hashed = mix(grams ^ seeds[f])
                l, c, r = compact_windows(hashed, least, first)
                a, b = np.maximum(l, c - least + 1), np.minimum(r, c + least - 1)
                reach = lambda x, y: (w.start[at[c]] - w.start[at[x]]) << 32 | (w.end[at[y] + WIDTH - 1] - w.start[at[c]])
                centre = w.start[at[c]] << 32 | at[c] - w.first[text[c]]
                parts.append((hashed[c] << np.uint64(3) | np.uint64(f), rows[c], centre, reach(l, r), reach(a, b)))
            key, *columns = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((columns[1], columns[0], key))
            key, columns = key[order], [x[order] for x in columns]
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            head = _joined(key, fresh)
            # A window in the document of its partner joins nothing and need not travel.
            joined = np.flatnonzero(columns[0] != columns[0][head])
            fresh, head = np.flatnonzero(fresh), head[joined]
            key, row = key.view(np.int64), columns[0]
            for at, values in ((fresh, [x[fresh] for x in columns[1:]]), (joined, [x[joined] for x in columns[1:]] + [x[head] for x in columns])):
                window = np.stack(values, 1).astype(">i8")
                offsets = np.arange(len(at) + 1, dtype=np.int32) * np.int32(8 * len(values))
                window = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(window)])
                yield pa.record_batch([pa.array(key[at]), pa.array(row[at]), window], SENT)

    return docs.select("row", "text").mapInArrow(run, "key bigint, row bigint, window binary")


def _hits(windows: DataFrame) -> DataFrame:
    """Every window with the first one of its key, another document's; from a stream sorted by key, row and centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, None
        for batch in batches:
            window = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(window.buffers()[1], np.int64)[window.offset : window.offset + len(window) + 1]
            values = np.frombuffer(window.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(">i8")
            start = (offsets[:-1] - offsets[0]) // 8
            done = np.diff(offsets) == 8 * JOINED
            key, row = (np.asarray(c) for c in batch.columns[:2])
            out = [[key[done], row[done], *(values[start[done] + i].astype(np.int64) for i in range(JOINED))]]
            x = [key[~done], row[~done], *(values[start[~done] + i].astype(np.int64) for i in range(ALONE))]
            key = x[0]
            if len(key):
                fresh = np.ones(len(key), bool)
                fresh[1:] = key[1:] != key[:-1]
                head = _joined(key, fresh)
                x += [c[head] for c in x[1:]]
                if key[0] == last_key:  # the key began in an earlier batch
                    x[5:] = [np.where(key == last_key, old, c) for old, c in zip(last, x[5:])]
                last_key, last = key[-1], [c[-1] for c in x[5:]]
                other = x[5] != x[1]
                out.append([c[other] for c in x])
            yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], COLUMNS)

    # Joined windows need not meet: they are spread.
    to = F.when(F.octet_length("window") == 8 * JOINED, F.xxhash64("row", "window")).otherwise(F.col("key"))
    return windows.repartition(to).sortWithinPartitions("key", "row", "window").mapInArrow(run, SCHEMA)


def _candidates(hits: DataFrame) -> DataFrame:
    """(o_row, row, l, r, o_l, o_r): ranges of two documents on which enough functions agree, by an interval join.

    The hits of one pair of documents are taken in order of place; those whose windows overlap in both texts at about
    the same shift form a range. A pair's hits are bounded by the lengths of the two texts.
    """
    names = ["o_row", "row", "l", "r", "o_l", "o_r"]

    def ranges_of(pair) -> Iterator[list]:
        ranges: list[list] = []  # l, r, o_l, o_r, shift, functions as bits
        live: list[list] = []
        for f, c, l, r, o_c, o_l, o_r in pair:
            live = [g for g in live if g[1] >= c - DRIFT]  # hits come in order of their centres
            shift, own = o_c - c, None
            for g in live:
                if l < g[1] and g[0] < r and o_l < g[3] and g[2] < o_r and -DRIFT <= shift - g[4] <= DRIFT:
                    own = g
                    break
            if own is None:
                own = [l, r, o_l, o_r, shift, 0]
                ranges.append(own), live.append(own)
            if l < own[0]:
                own[0] = l
            if r > own[1]:
                own[1] = r
            if o_l < own[2]:
                own[2] = o_l
            if o_r > own[3]:
                own[3] = o_r
            own[4] = shift
            own[5] |= 1 << f
        return (g[:4] for g in ranges if g[5].bit_count() >= ENOUGH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the rows of the pair that the stream stands in
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = [np.asarray(batch.column(n)) for n in ("o_row", "row", "key", "c", "wide", "o_c", "o_wide")]
                fresh = np.flatnonzero((new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1])) + 1
                if held and (held[-1][0][-1], held[-1][1][-1]) != (new[0][0], new[1][0]):
                    fresh = np.concatenate([[0], fresh])
                if not len(fresh):
                    held.append(new)
                    continue
                done, held = [*held, [x[: fresh[-1]] for x in new]], [[x[fresh[-1] :] for x in new]]
            else:
                done, held = held, []
            if not done:
                continue
            x = [np.concatenate(c) for c in zip(*done)]
            if not len(x[0]):
                continue
            x[2] = x[2] & 7
            fresh = np.ones(len(x[0]), bool)
            fresh[1:] = (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])
            begin = np.flatnonzero(fresh)
            # A pair on which one function agrees has no candidate.
            many = np.minimum.reduceat(x[2], begin) != np.maximum.reduceat(x[2], begin)
            many = many[np.cumsum(fresh) - 1]
            x = [c[many] for c in x]
            ends = lambda c, reach: (c - (reach >> 32), c + (reach & ((1 << 32) - 1)))
            x = [c.tolist() for c in (*x[:4], *ends(x[3], x[4]), x[5], *ends(x[5], x[6]))]
            borders = [*np.flatnonzero(fresh[many]).tolist(), len(x[0])]
            found = []
            for low, high in zip(borders[:-1], borders[1:]):
                found += [(x[0][low], x[1][low], *g) for g in ranges_of(zip(*[c[low:high] for c in x[2:]]))]
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names)

    asked = hits.select("key", "row", F.shiftright("c", 32).alias("c"), "wide", "o_row", F.shiftright("o_c", 32).alias("o_c"), "o_wide")
    ordered = asked.repartition("o_row", "row").sortWithinPartitions("o_row", "row", "c", "o_c", "key")
    return ordered.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _common_shift(own: np.ndarray, lo: np.ndarray, hi: np.ndarray, order: np.ndarray, n: int) -> int:
    """The shift at which most of the places ``own`` match, over all occurrences ``order[lo:hi]`` of their n-grams."""
    votes = np.zeros(len(order) + n, np.int64)
    ends = np.cumsum(hi - lo)
    begin = 0
    while begin < len(own):  # about a million occurrences at a time
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 20), "right")))
        count = (hi - lo)[begin:end]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        votes += np.bincount(order[np.repeat(lo[begin:end], count) + inside] - np.repeat(own[begin:end], count) + n, minlength=len(votes))
        begin = end
    return int(np.argmax(votes)) - n


def _nearest(target: np.ndarray, lo: np.ndarray, hi: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each one's occurrences ``order[lo:hi]``, which ascend, the one nearest to ``target``; by bisection of all at once."""
    left, right = lo.copy(), hi.copy()
    while (open_ := left < right).any():
        middle = (left + right) // 2
        less = open_ & (order[np.minimum(middle, len(order) - 1)] < target)
        left, right = np.where(less, middle + 1, left), np.where(open_ & ~less, middle, right)
    after, before = order[np.minimum(left, hi - 1)], order[np.maximum(left - 1, lo)]
    return np.where(np.abs(before - target) < np.abs(after - target), before, after)


def matching_runs(match: np.ndarray) -> list[list[tuple[int, int]]]:
    """Runs of matching places as lists of their gapless pieces; a run goes on over a gap while at least ``SIMILAR`` of it match."""
    framed = np.zeros(len(match) + 2, bool)
    framed[1:-1] = match
    edges = np.flatnonzero(framed[1:] != framed[:-1]).tolist()
    merged: list[list[tuple[int, int]]] = []
    inside = 0
    for a, b in zip(edges[::2], edges[1::2]):
        if merged and inside + b - a >= SIMILAR * (b - merged[-1][0][0]):
            merged[-1].append((a, b))
            inside += b - a
        else:
            merged.append([(a, b)])
            inside = b - a
    return merged


def long_runs(match: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    """Those of ``matching_runs`` that are of at least ``least`` places."""
    return [run for run in matching_runs(match) if run[-1][1] - run[0][0] >= least]


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; a sort, which is several times faster than ``np.unique`` on a few of them."""
    x = np.sort(x)
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    return x[fresh]


def similar_runs(later: np.ndarray, earlier: np.ndarray, least: int) -> list[tuple[int, int, int, int, float]]:
    """(from, to, earlier from, earlier to, Jaccard) of passages of at least ``least`` n-grams, ends exclusive.

    N-grams of ``later`` that occur in ``earlier`` make runs. A run goes on over a gap while at least ``SIMILAR`` of its n-grams
    match; its partner is the most alike of the place at the run's commonest shift, the hull of the occurrences that are
    nearest to that or to the median shift, and the hull of the first occurrences.
    """
    order = np.argsort(earlier, kind="stable")
    inorder = earlier[order]
    at = np.searchsorted(inorder, later)
    near = np.minimum(at, len(earlier) - 1)
    match = inorder[near] == later
    merged = long_runs(match, least)
    if not merged:
        return []
    upto = np.searchsorted(inorder, later, "right")
    where = order[near]
    single = not (inorder[1:] == inorder[:-1]).any()  # no n-gram of the earlier text repeats
    out = []
    while merged:
        run = merged.pop()
        a, b = run[0][0], run[-1][1]
        if b - a < least:
            continue
        own = a + np.flatnonzero(match[a:b])
        held = where[own]
        mine = _distinct(later[a:b])
        one, best = len(mine), (0.0, 0, 0)
        # Passages that repeat themselves match far from any one shift.
        ranges = {(int(held.min()), int(held.max()) + 1)}
        common = int(np.argmax(np.bincount(held - own + len(later)))) - len(later) if single else _common_shift(own, at[own], upto[own], order, len(later))
        ranges.add((max(a + common, 0), min(b + common, len(earlier))))
        shifts = np.sort(held - own)
        median = int((shifts[(len(own) - 1) // 2] + shifts[len(own) // 2]) / 2)
        for shift in {common, median}:
            places = held if single else _nearest(own + shift, at[own], upto[own], order)
            near = places[np.abs(places - own - shift) <= (b - a) // 4 + 1]
            if len(near):
                ranges.add((int(near.min()), int(near.max()) + 1))
        if single:  # an n-gram in common is one place of the earlier text
            common_places = _distinct(held)
        for x, y in sorted(ranges):
            if single:
                both, two = int(np.diff(np.searchsorted(common_places, (x, y)))[0]), y - x
            else:
                other = _distinct(earlier[x:y])
                both, two = int(np.count_nonzero(mine[np.minimum(np.searchsorted(mine, other), one - 1)] == other)), len(other)
            best = max(best, (both / (one + two - both), x, y), key=lambda v: v[0])
        similarity, x, y = best
        if similarity >= SIMILAR:
            out.append((a, b, x, y, similarity))
        elif len(run) > 1:  # the passages on both sides of the widest gap may be alike by themselves
            k = max(range(1, len(run)), key=lambda i: run[i][0] - run[i - 1][1])
            merged += [run[:k], run[k:]]
    return out


FOUND = "doc_id bigint, start bigint, end bigint, n_words bigint, source_id bigint, source_start bigint, source_end bigint, similarity double, passage_crc32 bigint"


def _verified(docs: DataFrame, candidates: DataFrame, least_words: int) -> DataFrame:
    """Exact check of the candidates on the bytes of both ranges."""
    asked = stored(candidates.withColumn("candidate", F.monotonically_increasing_id()), "ranges")
    sides = asked.select(F.col("row").alias("at"), "candidate", F.lit(1).alias("side"), F.col("l").alias("a"), F.col("r").alias("b")).union(
        asked.select(F.col("o_row"), "candidate", F.lit(0), F.col("o_l"), F.col("o_r"))
    )
    # Only the asked bytes go on; a text that many ask for is not copied for each of them.
    cut = docs.select(F.col("row").alias("at"), F.encode("text", "utf-8").alias("bytes")).join(sides, "at").select(
        "candidate", "side", "at", "a", F.expr("substring(bytes, cast(a + 1 as int), cast(b - a as int))").alias("words")
    )
    names = [c.split(" ")[0] for c in FOUND.split(", ")]
    types = [pa.float64() if n == "similarity" else pa.int64() for n in names]
    least = least_words - WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, "candidate", "words"):
            side, at, start = (block.column(n).to_pylist() for n in ("side", "at", "a"))
            candidate, texts = np.asarray(block.column("candidate")), block.column("words").to_pylist()
            borders = [0, *(np.flatnonzero(candidate[1:] != candidate[:-1]) + 1).tolist(), len(candidate)]
            w = words(pa.array(texts, pa.binary()))
            grams, _, first = text_grams(w)
            rows = []
            for low, high in zip(borders[:-1], borders[1:]):
                # One row a side, but for rows that repeat an id: then all pairs of their texts.
                for i, j in ((i, j) for i in range(low, high) for j in range(low, high) if side[i] == 0 and side[j] == 1):
                    (k, m), (p, q) = w.first[i : i + 2], w.first[j : j + 2]
                    if m - k < least_words or q - p < least_words:
                        continue
                    for a, b, x, y, s in similar_runs(grams[first[j] : first[j + 1]], grams[first[i] : first[i + 1]], least):
                        lo, hi = int(w.start[p + a]), int(w.end[p + b + WIDTH - 2])
                        rows.append((
                            at[j], start[j] + lo, start[j] + hi, b - a + WIDTH - 1, at[i], start[i] + int(w.start[k + x]),
                            start[i] + int(w.end[k + y + WIDTH - 2]), s, zlib.crc32(texts[j][lo:hi]),
                        ))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    ordered = cut.repartition("candidate").sortWithinPartitions("candidate", "side", "words")
    return ordered.mapInArrow(run, FOUND)


def _least_shared(grams: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Distinct n-grams that a text similar to any run of ``least`` n-grams of text ``i`` shares with it, at least, for all texts of so many.

    ``first[i] : first[i + 1]`` are the n-grams of text ``i``.
    """
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((grams, text))
    again = np.flatnonzero((grams[order[1:]] == grams[order[:-1]]) & (text[order[1:]] == text[order[:-1]]))
    before, at = order[again], order[again + 1]
    # A place is a repeat in the runs that hold the one before it too.
    begin = np.maximum(at - least + 1, first[text[at]])
    inside = begin <= before
    change = np.bincount(begin[inside], minlength=len(text) + 1) - np.bincount(before[inside] + 1, minlength=len(text) + 1)
    repeats = np.cumsum(change)[: len(text)]
    repeats[np.arange(len(text)) > first[1:][text] - least] = 0  # no whole run begins there
    most = np.zeros(len(count), np.int64)
    most[count > 0] = np.maximum.reduceat(repeats, first[:-1][count > 0]) if len(text) else 0
    return np.ceil(SIMILAR * (least - most) - 1e-9).astype(np.int64)


def dense(match: np.ndarray, size: int, share: float) -> np.ndarray:
    """Whether each row of ``match`` has a run of at least ``size`` places of which at least ``share`` match."""
    if match.shape[1] < size:
        return np.zeros(len(match), bool)
    part = Fraction(share).limit_denominator(1000)
    total = np.zeros((len(match), match.shape[1] + 1), np.int32)
    np.cumsum(match * np.int32(part.denominator) - np.int32(part.numerator), axis=1, out=total[:, 1:])
    return (total[:, size:] >= np.minimum.accumulate(total[:, : total.shape[1] - size], axis=1)).any(axis=1)


def _ascending(lists: list[list[int]], end: int) -> Iterator[int]:
    """The distinct members below ``end`` of ascending lists, in order; of a frequent n-gram's list only as much is read as is asked for."""
    low, high = 0, 64
    while low < end:
        yield from sorted({j for x in lists for j in x[bisect_left(x, low) : bisect_left(x, high)]})
        low, high = high, 4 * high


def similar_texts(rows: list[int], wanted: list[bool], grams: list[np.ndarray], least: int) -> Iterator[tuple[int, int, list[tuple]]]:
    """(i, j, ``similar_runs``) of each wanted text i and the first text j of a smaller row that it has a passage with.

    Texts come in order of their rows. Two texts that share t n-grams have one in common among all but t - 1 of each
    one's n-grams, in any order of the n-grams; the rarest are taken first. Only texts that share enough are compared.
    """
    length = np.array([len(g) for g in grams])
    first = np.concatenate([[0], np.cumsum(length)])
    values, ids = np.unique(np.concatenate(grams), return_inverse=True)
    text = np.repeat(np.arange(len(grams)), length)
    owner, own = np.divmod(np.unique(text * len(values) + ids), len(values))
    count = np.bincount(own, minlength=len(values))
    # N-grams of one text propose nothing and match nothing: all of them are number 0.
    single = int(np.count_nonzero(count == 1))
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.maximum(np.arange(1, len(count) + 1) - single, 0)
    ids = place[ids]
    at = np.searchsorted(owner, np.arange(len(grams) + 1)).tolist()
    once = np.diff(at) == length
    own = np.sort(owner * (len(values) + 1) + place[own]) % (len(values) + 1)  # the distinct n-grams of every text, its rarest first
    flags = np.zeros((AT_ONCE, len(values) - single + 1), bool)
    usual = int(np.ceil(SIMILAR * least - 1e-9))
    needs = _least_shared(np.concatenate(grams), first, least).tolist()
    held: dict[int, list[int]] = {}
    for i, g in enumerate(grams):
        mine, need, here = own[at[i] : at[i + 1]], needs[i], ids[first[i] : first[i + 1]]
        rare = mine[: len(mine) - need + 1]
        rare = rare[rare > 0].tolist()
        if wanted[i]:
            earlier = (j for j in _ascending([held[k] for k in rare if k in held], i) if rows[j] < rows[i])
            size, done = FIRST, False
            while not done and (tried := list(islice(earlier, size))):
                size = AT_ONCE
                tried = np.array(tried)
                line = np.repeat(np.arange(len(tried)), length[tried])
                inside = np.arange(int(length[tried].max())) < length[tried][:, None]
                there = ids[np.arange(len(line)) + np.repeat(first[tried] - np.cumsum(length[tried]) + length[tried], length[tried])]
                flags[line, there] = True
                flags[:, 0] = False
                may = flags[: len(tried), mine].sum(axis=1) >= need
                match = flags[: len(tried), here]
                may[may] = dense(match[may], least, SIMILAR)
                strict = np.flatnonzero(may & once[tried]) if once[i] else []
                if len(strict):
                    flags[line, there] = False
                    flags[0, here] = True
                    flags[0, 0] = False
                    back = np.zeros(inside.shape, bool)
                    back[inside] = flags[0, there]
                    flags[0, here] = False
                    back = back[strict]
                    may[strict] = dense(match[strict], least, CLOSER) & dense(back, usual, SIMILAR) | dense(back, usual, CLOSER)
                else:
                    flags[line, there] = False
                for k in np.flatnonzero(may).tolist():
                    j = int(tried[k])
                    found = similar_runs(g, grams[j], least) if long_runs(match[k], least) else []
                    if found:
                        done = True
                        yield i, j, found
                        break
        for k in rare:
            held.setdefault(k, []).append(i)


def similar_pairs(rows: np.ndarray, wanted: np.ndarray, grams: np.ndarray, first: np.ndarray, group: np.ndarray, least: int) -> Iterator[tuple[int, int, list[tuple]]]:
    """What ``similar_texts`` finds, for many groups of at most ``SMALL`` texts at once; texts come in order of group and row.

    All pairs of texts of a group that share n-grams are listed, at most ``SMALL`` for each n-gram of a text; the rarest n-grams that propose,
    counts and dense runs are those of ``similar_texts``.
    """
    usual = int(np.ceil(SIMILAR * least - 1e-9))
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    group = np.cumsum(np.diff(group, prepend=group[:1]) != 0)
    # The n-grams of every group by their order: ``begin`` is the number of each group's first one.
    order = np.lexsort((grams, group[text]))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (grams[order[1:]] != grams[order[:-1]]) | (group[text[order[1:]]] != group[text[order[:-1]]])
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(fresh) - 1
    size = np.bincount(group[text[order[fresh]]], minlength=int(group[-1]) + 1)
    begin = (np.cumsum(size) - size)[group]
    shared, owner = np.divmod(_distinct(ids * len(count) + text), len(count))
    distinct = np.bincount(owner, minlength=len(count))
    repeats = distinct < count
    need = _least_shared(grams, first, least)
    fresh = np.ones(len(shared), bool)
    fresh[1:] = shared[1:] != shared[:-1]
    held = np.diff(np.flatnonzero(np.append(fresh, True)))[np.cumsum(fresh) - 1]  # texts of the group with the n-gram
    rarest = np.empty(len(shared), np.int64)
    rarest[np.lexsort((shared, held, owner))] = np.arange(len(shared)) - np.repeat(np.cumsum(distinct) - distinct, distinct)
    rare = rarest <= (distinct - need)[owner]
    found = []
    for apart in range(1, SMALL):
        at = np.flatnonzero(shared[apart:] == shared[:-apart])
        if not len(at):
            break
        later, earlier = owner[at + apart], owner[at]
        asked = wanted[later] & (rows[earlier] < rows[later])
        # The last bit tells whether the n-gram proposes the pair; a pair's proposals are its last ones in order.
        found.append((later[asked] * len(count) + earlier[asked]) << 1 | (rare[at] & rare[at + apart])[asked])
    found = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    if not len(found):
        return
    last = np.flatnonzero(np.append(found[1:] >> 1 != found[:-1] >> 1, True))
    common = np.diff(last, prepend=-1)
    later, earlier = np.divmod(found[last] >> 1, len(count))
    enough = (common >= need[later]) & (found[last] & 1 == 1)
    later, earlier = later[enough], earlier[enough]
    most = int(count.max(initial=0))
    inside = np.arange(most) < count[:, None]
    each = np.zeros((len(count), most), np.int64)
    each[inside] = ids - begin[text]
    # Which n-grams of its group each text has, a byte for each: as many as the groups' texts times their n-grams.
    cells = size[group]
    base = np.cumsum(cells) - cells
    has = np.zeros(int(cells.sum()), bool)
    has[base[owner] + shared - begin[owner]] = True
    # Most texts are like the first ones already; the other pairs are tried of those that are not.
    number = np.arange(len(later)) - np.searchsorted(later, later)
    done = np.zeros(len(count), bool)
    for tried in (number < FIRST, number >= FIRST):
        tried = np.flatnonzero(tried)
        tried = tried[~done[later[tried]]]
        for begin in range(0, len(tried), 1 << 12):
            at = tried[begin : begin + (1 << 12)]
            x, y = later[at], earlier[at]
            match = has[base[y][:, None] + each[x]] & inside[x]
            may = dense(match, least, SIMILAR)
            once = ~(repeats[x] | repeats[y])
            once = np.flatnonzero(may & once)
            x_, y_ = x[once], y[once]
            back = has[base[x_][:, None] + each[y_]] & inside[y_]
            may[once] = dense(match[once], least, CLOSER) & dense(back, usual, SIMILAR) | dense(back, usual, CLOSER)
            for i, j, k in zip(x[may].tolist(), y[may].tolist(), np.flatnonzero(may).tolist()):
                if not done[i] and long_runs(match[k], least):
                    passages = similar_runs(grams[first[i] : first[i + 1]], grams[first[j] : first[j + 1]], least)
                    if passages:
                        done[i] = True
                        yield i, j, passages


def sharing(grams: np.ndarray, first: np.ndarray, group: np.ndarray, long: np.ndarray, least: int) -> Iterator[list[int]]:
    """Per group of texts those that may be similar to another one of it: two at least, long enough, in order.

    ``first[i] : first[i + 1]`` are the n-grams of text ``i``. Similar texts share a least number of distinct n-grams with each other, so a
    text that shares fewer with all others of its group together is out. All groups of a block are counted at once, by one sort.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(long[text])
    text = text[at]
    # A collision of two hashes adds to a count and only keeps a text in.
    hashed = mix(grams[at] ^ mix(group[text].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(hashed, kind="stable")  # equal hashes stay in order of their texts
    hashed, text = hashed[order], text[order]
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = hashed[1:] != hashed[:-1]
    begin = np.flatnonzero(fresh)
    last = np.concatenate([begin[1:], [len(hashed)]]) - 1 if len(begin) else begin
    shared = np.repeat(text[begin] != text[last], last - begin + 1)
    once = fresh.copy()
    once[1:] |= text[1:] != text[:-1]
    count = np.bincount(text[shared & once], minlength=len(long))
    # Texts that repeat n-grams have fewer distinct ones; their groups take the least need.
    need = np.full(int(group[-1]) + 1 if len(group) else 0, int(np.ceil(SIMILAR * least - 1e-9)))
    again = np.unique(text[~once])
    again = again[count[again] > 0]
    if len(again):
        own = [grams[first[i] : first[i + 1]] for i in again.tolist()]
        np.minimum.at(need, group[again], _least_shared(np.concatenate(own), np.concatenate([[0], np.cumsum([len(g) for g in own])]), least))
    kept = np.flatnonzero(long & (count >= need[group]))
    for of_key in np.split(kept, np.flatnonzero(np.diff(group[kept])) + 1):
        if len(of_key) > 1:
            yield of_key.tolist()


def codes(w) -> np.ndarray:
    """One byte of every word's hash: enough to turn away most texts that share too few n-grams, of five bytes each."""
    return (w.hash >> np.uint64(56)).astype(np.uint8)


def may_share(code: np.ndarray, first: np.ndarray, group: np.ndarray, row: np.ndarray, opened: np.ndarray, least: int, seen: np.ndarray) -> np.ndarray:
    """Whether each text may be an open one with a passage of ``least`` n-grams that a text of its group and a smaller row has, or be that one.

    ``first[i] : first[i + 1]`` are the codes of text ``i``'s words; texts come in order of group and row; ``seen`` is working space of two times
    2 ** k integers. No similar texts are turned away: where two agree in a word they agree in its code, and collisions only add to the n-grams in
    common. A passage without repeated n-grams is a run that has at least ``SIMILAR`` of its n-grams in common with its source, whose own run is as
    long or shorter by that share. Passages that repeat n-grams need fewer, so their whole group is held to the least number only.
    """
    n = len(first) - 1
    count = np.maximum(np.diff(first) - WIDTH + 1, 0)
    shared = int(np.ceil(SIMILAR * least - 1e-9))
    most = max(int(count.max(initial=0)), least)
    text = np.repeat(np.arange(n), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count - first[:-1], count)
    grams = np.zeros(len(text), np.uint64)
    for i in range(WIDTH):
        grams = grams << np.uint64(8) | code[at + i]
    inside = np.arange(most) < count[:, None]
    # Distinct values stand for the n-grams that a text does not have.
    each = np.broadcast_to(np.arange(most, dtype=np.uint64) | np.uint64(1 << 63), (n, most)).copy()
    each[inside] = grams
    each.sort(axis=1)
    repeated = (each[:, 1:] == each[:, :-1]).sum(axis=1)
    fresh = np.ones(n, bool)
    fresh[1:] = (group[1:] != group[:-1]) | (row[1:] != row[:-1])
    owner = np.cumsum(fresh)
    slot = (mix(grams ^ mix(group.astype(np.uint64))[text]) & np.uint64(seen.shape[1] - 1)).astype(np.int64)
    mine = owner[text]
    # The first document that has an n-gram, and the last one that has it in an open text: written from the back and from the front.
    seen[0][slot[::-1]] = mine[::-1]
    seen[1][slot] = 0
    seen[1][slot[opened[text]]] = mine[opened[text]]
    # The distinct n-grams of a passage: all but those outside of it, at least.
    need = np.full(int(group[-1]) + 1 if n else 0, shared)
    np.minimum.at(need, group, np.maximum(np.ceil(SIMILAR * (least - repeated) - 1e-9), 1).astype(np.int64))
    need = need[group]

    def enough(matching: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        match = np.zeros((n, most), bool)
        match[inside] = matching
        repeats, common = need < shared, match.sum(axis=1) >= need
        return common & (repeats | dense(match, size, SIMILAR)), common & (repeats | dense(match, size, CLOSER))

    later, closer_later = enough(seen[0][slot] < mine, least)
    source, closer_source = enough(seen[1][slot] > mine, shared)
    closer = np.bincount(group, opened & closer_later | closer_source) > 0
    return (opened & later | source) & closer[group]


def _may_share(asked: DataFrame, least_words: int) -> DataFrame:
    """The windows of ``asked`` (key, row, open, c, near, code) that ``may_share`` a passage with another one of their key."""
    least = least_words - WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << 20), np.int32)
        for block in whole_groups(batches, "key", "code", 1 << 18):
            batch = block.combine_chunks().to_batches()[0]
            key, row = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            code = batch.column(5).cast(pa.large_binary())
            first = np.frombuffer(code.buffers()[1], np.int64)[code.offset : code.offset + len(code) + 1]
            data = np.frombuffer(code.buffers()[2], np.uint8)[first[0] : first[-1]]
            kept = may_share(data, first - first[0], group, row, np.asarray(batch.column(2).to_numpy(zero_copy_only=False)), least, seen)
            if kept.any():
                yield batch.filter(pa.array(kept)).select(range(5))

    ordered = asked.repartition("key").sortWithinPartitions("key", "row")
    return ordered.mapInArrow(run, "key bigint, row bigint, open boolean, c bigint, near bigint")


def _coded(docs: DataFrame) -> DataFrame:
    """(row, code): a byte for every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            w = words(batch.column(1))
            code = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(w.first.astype(np.int64)), pa.py_buffer(codes(w))])
            yield pa.record_batch([batch.column(0), code.cast(pa.binary())], ["row", "code"])

    return docs.select("row", "text").mapInArrow(run, "row bigint, code binary")


def _others(docs: DataFrame, hits: DataFrame, found: DataFrame, least_words: int) -> DataFrame:
    """Passages around the windows of ``hits`` whose centre lies in none of ``found``, with any window of their keys."""
    spans = found.groupBy(F.col("doc_id").alias("row")).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    at = F.shiftright("c", 32)
    inside = F.exists("_spans", lambda x: (x["start"] <= at) & (at < x["end"]))
    left = hits.select("key", "row", "c", "near").join(spans, "row", "left").withColumn("open", ~F.coalesce(inside, F.lit(False)))
    first = hits.select("key", F.col("o_row").alias("row"), F.col("o_c").alias("c"), F.col("o_near").alias("near"), F.lit(False).alias("open"))
    both = left.drop("_spans").select(*first.columns).union(first.distinct())
    keys = stored(left.where("open").select("key").distinct(), "open")
    # The codes of all words that passages of least length around the centre may have; the exact check is on the words.
    least = least_words - WIDTH + 1
    word = F.col("c").bitwiseAND(F.lit((1 << 32) - 1))
    from_ = F.greatest(word - (least - 1), F.lit(0))
    near = both.join(keys, "key", "left_semi").join(_coded(docs), "row").select("key", "row", "open", "c", "near", F.col("code").substr((from_ + 1).cast("int"), (word + least + WIDTH - 1 - from_).cast("int")).alias("code"))
    kept = stored(_may_share(near, least_words), "sharing")
    before, after = F.shiftright("near", 32), F.col("near").bitwiseAND(F.lit((1 << 32) - 1))
    asked = kept.select("key", "row", "open", (at - before).alias("l"), (at + after).alias("r"))
    cut = docs.select("row", F.encode("text", "utf-8").alias("bytes")).join(asked, "row").select(
        "key", "row", "l", "open", F.expr("substring(bytes, cast(l + 1 as int), cast(r - l as int))").alias("words")
    )
    names = [c.split(" ")[0] for c in FOUND.split(", ")]
    types = [pa.float64() if n == "similarity" else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches, "key", "words"):
            rows, start, opened, texts = (block.column(n).to_pylist() for n in ("row", "l", "open", "words"))
            key = np.asarray(block.column("key"))
            group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]).tolist()
            # Equal words in a later document: held against the first document that has them, which stands for all of them.
            seen: dict[tuple[int, bytes], int] = {}
            again = [seen.setdefault((g, t), len(seen)) for g, t in zip(group, texts)]
            firsts = np.flatnonzero(np.diff(np.maximum.accumulate(again), prepend=-1)).tolist()
            w = words(pa.array([texts[i] for i in firsts], pa.binary()))
            long = (np.diff(w.first) >= least_words).tolist()
            wanted: dict[int, list[int]] = {}
            pairs = []
            for i, j in enumerate(again):
                if opened[i] and long[j]:
                    if rows[firsts[j]] < rows[i]:
                        n = int(w.first[j + 1] - w.first[j]) - WIDTH + 1
                        pairs.append((i, j, j, [(0, n, 0, n, 1.0)]))
                    else:  # where any of equal texts is open, it is looked for
                        wanted.setdefault(j, []).append(i)
            grams, _, first = text_grams(w)
            owner = np.array(group)[firsts]
            text_row = np.array([rows[i] for i in firsts])
            asked = np.zeros(len(firsts), bool)
            asked[list(wanted)] = True
            small: list[list[int]] = [[]]
            lengths, pending = np.diff(first), 0
            for of_key in sharing(grams, first, owner, np.array(long), least):
                if not asked[of_key].any():
                    continue
                if len(of_key) > SMALL:
                    own = [grams[first[j] : first[j + 1]] for j in of_key]
                    sought = similar_texts(text_row[of_key].tolist(), asked[of_key].tolist(), own, least)
                    pairs += [(i, of_key[x], of_key[y], f) for x, y, f in sought for i in wanted[of_key[x]]]
                    continue
                pending += len(of_key) * int(lengths[of_key].sum()) // 2
                if pending > PAIRS:
                    small.append([])
                    pending = 0
                small[-1] += of_key
            for texts_of in filter(None, small):
                own = [grams[first[j] : first[j + 1]] for j in texts_of]
                borders = np.concatenate([[0], np.cumsum([len(g) for g in own])])
                sought = similar_pairs(text_row[texts_of], asked[texts_of], np.concatenate(own), borders, owner[texts_of], least)
                pairs += [(i, texts_of[x], texts_of[y], f) for x, y, f in sought for i in wanted[texts_of[x]]]
            out = []
            for i, x, y, passages in pairs:
                p, k, j = w.first[x], w.first[y], firsts[y]
                for a, b, c, d, s in passages:
                    lo, hi = int(w.start[p + a]), int(w.end[p + b + WIDTH - 2])
                    out.append((
                        rows[i], start[i] + lo, start[i] + hi, b - a + WIDTH - 1, rows[j], start[j] + int(w.start[k + c]),
                        start[j] + int(w.end[k + d + WIDTH - 2]), s, zlib.crc32(texts[i][lo:hi]),
                    ))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return cut.repartition("key").sortWithinPartitions("key", "row", "l").mapInArrow(run, FOUND)


def find(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages of later documents that repeat one of an earlier document, without duplicates.

    Columns as in ``FOUND``: bytes of the UTF-8 text, end exclusive, and the checksum of the passage.
    """
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("row"), F.col("text").cast("string").alias("text"))
    hits = stored(_hits(_windows(texts, least_words)), "hits")
    found = stored(_verified(texts, _candidates(hits), least_words).distinct(), "first")
    return found.union(_others(texts, hits, found, least_words)).distinct()


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the bytes of their passages; overlapping passages are cut out once, all other bytes stay."""
    # The passages of one document: as many as its own length allows.
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "passage_crc32"))).alias("_spans"))
    raw = F.encode("text", "utf-8")
    # A row that only shares the id of the document with the passage keeps its text.
    own = lambda x: F.crc32(F.substring(raw, x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int"))) == x["passage_crc32"]
    joined = docs.join(spans, "doc_id", "left").withColumn("_spans", F.filter("_spans", own))
    state = "struct<at:bigint,out:array<binary>>"
    piece = lambda a, b: F.array(F.substring(raw, a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int")))
    add = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], piece(s["at"], x["start"])).alias("out")).cast(state)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<binary>").alias("out")).cast(state)
    done = lambda s: F.concat(s["out"], piece(s["at"], F.octet_length(raw).cast("bigint")))
    left = F.aggregate("_spans", start, add, done)
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda b: F.decode(b, "utf-8")), ""))
    return joined.withColumn("text", text).select(*docs.columns)
