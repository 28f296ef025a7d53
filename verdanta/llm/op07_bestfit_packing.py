"""Packing documents into sequences of at most ``capacity`` tokens by large-item matching, then best fit.

A document is its token ids and one end id; only documents longer than a sequence are cut, into full pieces
and a rest. Pieces above a third of the capacity are large: at most two of them fit one sequence, so they are
matched greedily, the longest first, each with the longest large piece that still fits. Smaller pieces then
go, the longest first, to the sequence with the least gap that holds them, and open new ones where none does.

The plan is made from the number of pieces of each length, which is at most ``capacity`` numbers however many
documents there are; equal lengths and equal gaps are handled as runs. It is a list of runs: the pieces of one
length with ranks from a to b go to consecutive sequences at one offset. Every piece gets its rank within its
length, where a length of many pieces is dealt to shares of about ``SHARE`` pieces that are ranked apart and
follow each other by their counts, and looks its run up in the plan.

Cases: a null or empty text is its end id alone; repeated rows are packed one by one; equal lengths are taken
in any order. Extra columns are ignored. An empty table gives no pieces.
"""

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .texts import slices
from .wordpieces import WordPieces
from .words import hashes, spans

CAPACITY, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SHARE = 1 << 10
_ENCODERS: dict[str, WordPieces] = {}


def encoder(path: str) -> WordPieces:
    """The worker's encoder, which keeps words that it has seen of late."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordPieces(path)
    return _ENCODERS[path]


def coded(column: pa.Array, path: str, end_id: int = END_ID) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) of slices of an Arrow column of texts: each text's ids, the end id last."""
    words = encoder(path)
    for first, end, data, offsets in slices(column):
        starts, ends, upto = spans(data, offsets)
        ids, n = words.encode(data, starts, ends, hashes(data, starts, ends))
        edge = np.concatenate([[0], np.cumsum(n)])[upto]
        edge += np.arange(len(edge))  # each text's end id comes on top
        out = np.full(edge[-1], end_id, np.uint32)
        own = np.ones(len(out), bool)
        own[edge[1:] - 1] = False
        out[own] = ids
        yield first, end, out, edge


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, ids, edge in coded(batch.column(1), tokenizer, end_id):
                sizes = np.diff(edge)
                n = -(-sizes // capacity)
                of = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[of] - start, capacity)
                raw, at = memoryview(ids.astype("<u4").view(np.uint8)), 4 * (edge[of] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                doc = batch.column(0).slice(first, end - first).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of runs, from the number of pieces by length; a run ends where the next of its length begins."""
    runs, taken, opened = [], dict.fromkeys(counts, 0), 0
    gaps: list[int] = []  # the gaps that some sequences have, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, sequences)

    def leave(gap: int, first: int, n: int) -> None:
        if gap not in ranges:
            insort(gaps, gap)
            ranges[gap] = []
        ranges[gap].append((first, n))

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, taken[length], first, offset))
        taken[length] += n

    left = {length: n for length, n in counts.items() if n}
    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1
        if i < 0:  # no large piece fits beside it
            place(a, left[a], opened, 0)
            leave(capacity - a, opened, left[a])
            opened += left[a]
            large.pop()
            continue
        b = large[i]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if n:
            place(a, n, opened, 0)
            place(b, n, opened, a)
            leave(capacity - a - b, opened, n)
            opened += n
        if a == b and left[a] % 2:  # one piece of its length is left over; the next lower length may still join it
            left[a] = 1
            if i:
                c = large[i - 1]
                place(a, 1, opened, 0)
                place(c, 1, opened, a)
                leave(capacity - a - c, opened, 1)
                left[c] -= 1
            else:
                place(a, 1, opened, 0)
                leave(capacity - a, opened, 1)
            opened += 1
            left[a] = 0
        else:
            left[a] -= n
            left[b] -= n
        large = [x for x in large if left[x]]

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[length]
        while n:
            i = bisect_left(gaps, length)
            if i == len(gaps):  # none holds it: open sequences for as many as fill them
                each = capacity // length
                full, rest = divmod(n, each)
                for k in range(each):
                    if full:
                        place(length, full, opened, k * length)
                if full:
                    leave(capacity - each * length, opened, full)
                for k in range(rest):
                    place(length, 1, opened + full, k * length)
                if rest:
                    leave(capacity - rest * length, opened + full, 1)
                opened += full + (rest > 0)
                break
            gap = gaps[i]
            first, m = ranges[gap].pop()
            if not ranges[gap]:
                del ranges[gap], gaps[i]
            # what one piece leaves is the least gap for the next one, so a sequence is filled before another is taken
            each = gap // length
            full = min(n // each, m)
            for k in range(each if full else 0):
                place(length, full, first, capacity - gap + k * length)
            if full:
                leave(gap - each * length, first, full)
            n -= each * full
            rest = n if full < m else 0
            for k in range(rest):
                place(length, 1, first + full, capacity - gap + k * length)
            if rest:
                leave(gap - rest * length, first + full, 1)
            if full + (rest > 0) < m:
                leave(gap, first + full + (rest > 0), m - full - (rest > 0))
            n -= rest
    return runs


def ranked(pieces: DataFrame, totals: dict[int, int], share: int = SHARE) -> DataFrame:
    """``pieces`` with their rank, from 0, within their length; a length of many pieces is ranked in shares of about ``share``."""
    shares = pieces.sparkSession.createDataFrame([(length, -(-n // share)) for length, n in totals.items()], "length long, shares long")  # at most capacity rows
    salted = pieces.join(F.broadcast(shares), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), "shares")).drop("shares")
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    return salted.withColumn("nth", nth).join(sizes, ["length", "salt"]).select(*pieces.columns, (F.col("base") + F.col("nth") - 1).alias("rank"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    pieces = stored(cut_documents(docs, tokenizer, capacity, end_id))
    # at most capacity rows, and runs: bounded by parameters, not by the documents
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(np.array(sorted(plan_runs(totals, capacity)), np.int64).reshape(-1, 4))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        edge = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows, own = np.flatnonzero(length == x), table[edge[x] : edge[x + 1]]
                k = np.searchsorted(own[:, 1], rank[rows], "right") - 1
                seq[rows], offset[rows] = own[k, 2] + rank[rows] - own[k, 1], own[k, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces, totals).mapInArrow(assigned, PIECES + ", sequence_id long, offset long")
