"""Removal of repeated passages by suffix arrays built with linear Lyndon grouping.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.
Every such string (a window) has a key: the least hash of its ``GRAM``-byte grams. Equal windows have equal
keys, neighbouring windows mostly share one, and a run of them makes a piece of the text. So:

1. of documents with equal texts (by SHA-256) only that with the smallest doc_id goes on; the others lose all;
2. every document's keys go to buckets by their own value, packed in few rows and shortened to 32 bits (in a
   bucket of bounded size hardly any meet by chance, and chance meetings do no harm); the keys that two
   documents have are sent back to the documents that have them. Keys that a sample of the documents shows to be
   common need no bucket: they are told to each document at once;
3. these documents cut the pieces of such keys; equal pieces of a batch are joined before the shuffle, and
   pieces are grouped by key. A key of more than ``HOT`` documents is cut into single windows that are dealt by
   their whole content, so a passage that a third of all documents hold is not one group;
4. the different pieces of a key, joined to one string, get a suffix array (see ``lyndon``); many strings are
   ordered at once. Equal windows stand side by side in it; the least doc_id of each such run tells which
   documents lose the window. Pieces that are equal byte for byte, which stand side by side, are joined before
   that; a key with one different piece needs no order. If more than ``PIECES`` are left they are dealt again by
   the keys of other hash functions, at last by content, since one long string can't share its steps with
   others. Single windows of hot keys come in order and are compared as a stream;
5. the lost stretches go back to their documents and are merged.

All readings of the texts by document are one shuffle, which Spark reuses.

Cases: a null text is empty and loses nothing, as does a text of fewer than ``LENGTH`` bytes; rows with equal
doc_ids never remove from each other, and repeated rows lose alike; rows with a null doc_id neither remove
nor lose. Extra columns are kept, whatever their names. An empty table gives an empty table.
"""

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lyndon import ranges, suffix_arrays
from .storage import Scratch, stored
from .texts import flat, slices
from .words import VALUE, hashes, mix

LENGTH, GRAM = 50, 20
STEP_BYTES, SLICE_BYTES = 1 << 19, 1 << 21
RUN = 32
HOT = 2000
PIECES, LEVELS = 16, 4
HELD_BYTES, HARD_BYTES = 1 << 21, 1 << 22
#: of one document in SAMPLED, and of LEAST of these at least, the share that makes a key common
SAMPLED, LEAST, COMMON = 64, 32, 0.002
BATCH_SYMBOLS = 1 << 19
BUCKET_KEYS = 1 << 20
COMPARED = 1 << 14
FACTOR = 0x9E3779B97F4A7C15
LOST = "doc long, tag int, s int, e int"
#: bytes, least doc_id, and the places where each window's least doc_id is kept
Piece = tuple[bytes, int, list[np.ndarray]]
OCCURRENCE = np.dtype([("doc", "<i8"), ("tag", "<i4"), ("s", "<i4")])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at every place, put together from hashes of 1, 2, 4, 8 and 16 bytes."""
    level, width, factor = VALUE[data], 1, FACTOR
    out, done = None, 0
    while True:
        if GRAM & width:
            part = level[done : len(data) - GRAM + 1 + done]
            out = part if out is None else out * np.uint64(factor) + part
            done += width
        if 2 * width > GRAM:
            return mix(out)
        level = level[:-width] * np.uint64(factor) + level[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)


def window_keys(data: np.ndarray, level: int = 0) -> np.ndarray:
    """The key of the window at every place, by the hash function of a level."""
    least, width, wanted = gram_hashes(data), 1, LENGTH - GRAM + 1
    if level:
        least = mix(least + np.uint64(level))
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])


def key_runs(data: np.ndarray, offsets: np.ndarray, level: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with one key: key, row, first window's place in ``data``, number of windows (RUN at most)."""
    for a in range(0, max(len(data) - LENGTH + 1, 0), STEP_BYTES):
        keys = window_keys(data[a : a + STEP_BYTES + LENGTH - 1], level)
        at = np.arange(a, a + len(keys))
        row = np.searchsorted(offsets, at, "right") - 1
        whole = at + LENGTH <= offsets[row + 1]
        change = np.ones(len(keys), bool)
        change[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
        begin = np.flatnonzero(change)
        n = np.diff(np.append(begin, len(keys)))
        begin, n = begin[whole[begin]], n[whole[begin]]
        cuts = -(-n // RUN)  # long runs of one key are cut
        part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first = np.repeat(begin, cuts) + part * RUN
        yield keys[first], row[first], first + a, np.minimum(np.repeat(n, cuts) - part * RUN, RUN)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ``sizes`` bytes from a are those from b."""
    out = np.ones(len(sizes), bool)
    for i in range(0, len(sizes), COMPARED):
        x, y, n = a[i : i + COMPARED], b[i : i + COMPARED], sizes[i : i + COMPARED]
        differs = data[ranges(x, x + n)] != data[ranges(y, y + n)]
        out[i : i + COMPARED] = ~np.logical_or.reduceat(differs, np.cumsum(n) - n)
    return out


def _common_keys(docs: DataFrame) -> np.ndarray:
    """Ascending keys that a noticeable share of a sample of documents has: at most 1 / COMMON times the keys of a mean document.

    They are known to be shared and hot, so they needn't meet in a bucket; which ones are found changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), SLICE_BYTES):
                for keys, row, _, _ in key_runs(data, offsets):
                    each = np.unique(row.astype(np.uint64) << np.uint64(32) | shortened(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(each.astype(np.uint32).view(np.int32))], names=["key"])

    scratch = Scratch()
    sample = scratch.stored(docs.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0).select("text").dropDuplicates())
    least = max(LEAST, int(COMMON * sample.count()))
    # a text longer than a step counts a key once per step
    counts = sample.mapInArrow(run, "key int").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = np.sort(np.array([r["key"] for r in counts.select("key").collect()], np.int32).view(np.uint32))
    scratch.clear()
    return found


def _keys_by_bucket(docs: DataFrame, buckets: int, common: np.ndarray) -> DataFrame:
    """(bucket, doc, tag, n, keys): per batch and bucket the different keys of the documents, packed.

    Common keys go by document, in buckets below 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)
    schema = pa.schema([("bucket", pa.int32()), ("doc", pa.binary()), ("tag", pa.binary()), ("n", pa.binary()), ("keys", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, data, offsets in slices(batch.column(2), SLICE_BYTES):
                found = [(keys, row) for keys, row, _, _ in key_runs(data, offsets)]
                if not found:
                    continue
                keys, row = (np.concatenate(c) for c in zip(*found, strict=True))
                short, bucket = shortened(keys), bucket_of(keys, buckets)
                known = np.isin(short, shared.value)
                bucket[known] = -1 - bucket_of(docs[first + row[known]].astype(np.uint64), buckets)
                order = np.lexsort((row, bucket))  # a key that a row repeats does no harm
                short, row, bucket = short[order], row[order], bucket[order]
                lead = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                rows: list[tuple] = []
                for s, e in zip(lead, [*lead[1:], len(short)], strict=True):
                    own, n = np.unique(row[s:e], return_counts=True)
                    rows.append((int(bucket[s]), docs[first + own].tobytes(), tags[first + own].tobytes(), n.astype("<i4").tobytes(), short[s:e].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select("doc", "tag", "text").mapInArrow(run, "bucket int, doc binary, tag binary, n binary, keys binary")


def shortened(keys: np.ndarray) -> np.ndarray:
    return mix(keys).astype("<u4")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(keys) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _shared_keys(by_bucket: DataFrame, partitions: int, most: int) -> DataFrame:
    """(doc, tag, keys, hot): the keys of each document that another document has too; those that very many have are in ``hot``."""

    def told(parts: list[tuple[bytes, ...]], common: bool) -> Iterator[pa.RecordBatch]:
        doc, tag = (np.concatenate([np.frombuffer(p[i], t).repeat(np.frombuffer(p[2], "<i4")) for p in parts]) for i, t in ((0, np.int64), (1, np.int32)))
        keys = np.concatenate([np.frombuffer(p[3], "<u4") for p in parts])
        order = np.lexsort((doc, keys))
        doc, tag, keys = doc[order], tag[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
        doc, tag, keys = doc[new], tag[new], keys[new]
        lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(lead, len(keys)))
        n = np.repeat(n, n)
        keep = common | (n > 1)
        doc, tag, keys, hot = doc[keep], tag[keep], keys[keep], common | (n[keep] > most)
        order = np.lexsort((tag, doc))
        doc, tag, keys, hot = doc[order], tag[order], keys[order], hot[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
        lead = np.flatnonzero(new)
        for at in range(0, len(lead), 8192):
            chunk = lead[at : at + 8192]
            pairs = list(zip(chunk, [*lead[at + 1 : at + 8193], *([len(doc)] if at + 8192 >= len(lead) else [])], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(doc[chunk]), pa.array(tag[chunk]), *(pa.array([keys[s:e][hot[s:e] == kind].tobytes() for s, e in pairs], pa.binary()) for kind in (False, True))], names=["doc", "tag", "keys", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and parts:
                    yield from told(parts, now < 0)
                    parts = []
                now = bucket
                parts.append(rest)
        if parts:
            yield from told(parts, now < 0)

    return by_bucket.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, tag int, keys binary, hot binary")


def packed_binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column from the bytes of all its values in a row."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def keys_of_rows(column: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys in a field of a column of lists of structs, and the n + 1 offsets of the rows' keys."""
    data, ends = flat(column.flatten().field(name))
    places = column.offsets.to_numpy() - column.offsets[0].as_py()
    return data.view("<u4") if len(data) else np.zeros(0, "<u4"), ends[places] // 4


def _pieces(texts: DataFrame) -> DataFrame:
    """(key, single, piece, least, found): the different pieces of shared keys in each batch with all their occurrences and the least doc_id."""
    schema = pa.schema([("key", pa.int32()), ("single", pa.bool_()), ("piece", pa.binary()), ("least", pa.int64()), ("found", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            shared = [keys_of_rows(batch.column(3), name) for name in ("keys", "hot")]
            for first, end, data, offsets in slices(batch.column(2), SLICE_BYTES):
                parts = [keys[ends[first] : ends[end]] for keys, ends in shared]
                wanted, flags = np.concatenate(parts), np.repeat([False, True], [len(p) for p in parts])
                of = np.concatenate([np.repeat(np.arange(end - first), np.diff(ends[first : end + 1])) for _, ends in shared])
                mine = of.astype(np.uint64) << np.uint64(32) | wanted
                order = np.argsort(mine)
                mine, flags = mine[order], flags[order]
                for keys, row, at, n in key_runs(data, offsets):
                    key = shortened(keys)
                    own = row.astype(np.uint64) << np.uint64(32) | key
                    spot = np.minimum(np.searchsorted(mine, own), len(mine) - 1)
                    ok = mine[spot] == own
                    key, row, at, n, hot = key[ok].view(np.int32), row[ok], at[ok], n[ok], flags[spot[ok]]
                    if not len(key):
                        continue
                    times = np.where(hot, n, 1)  # single windows of hot keys
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    single = np.repeat(hot, times)
                    key, row, at, n = np.repeat(key, times), np.repeat(row, times), np.repeat(at, times) + nth, np.where(single, 1, np.repeat(n, times))
                    begin, stop = at, at + n + LENGTH - 1
                    content = hashes(data[begin[0] : stop.max()], begin - begin[0], stop - begin[0])
                    key = np.where(single, (content >> np.uint64(32)).astype(np.uint32).view(np.int32), key)
                    found = np.empty(len(key), OCCURRENCE)
                    found["doc"], found["tag"], found["s"] = docs[row + first], tags[row + first], at - offsets[row]
                    order = np.lexsort((found["doc"], content, key, single))
                    key, single, content, found = key[order], single[order], content[order], found[order]
                    other = np.ones(len(key), bool)
                    other[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (single[1:] != single[:-1])
                    # equal hashes are a guess; the bytes tell
                    size, start = (stop - begin)[order], begin[order]
                    like = np.flatnonzero(~other)
                    like = like[size[like] == size[like - 1]]
                    other[1:] |= size[1:] != size[:-1]
                    other[like] = ~same_bytes(data, start[like], start[like - 1], size[like])
                    lead = np.flatnonzero(other)
                    whose = order[lead]
                    pieces = packed_binary(data[ranges(begin[whose], stop[whose])], stop[whose] - begin[whose])
                    blobs = packed_binary(found.view(np.uint8), np.diff(np.append(lead, len(found))) * OCCURRENCE.itemsize)
                    yield pa.RecordBatch.from_arrays([pa.array(key[lead]), pa.array(single[lead]), pieces, pa.array(found["doc"][lead]), blobs], schema=schema)

    return texts.select("doc", "tag", "text", "shared").mapInArrow(run, "key int, single boolean, piece binary, least long, found binary")


def least_owners(groups: list[list[tuple[bytes, int]]]) -> list[list[np.ndarray]]:
    """For each group of different pieces with their least doc_ids: per piece and window the least doc_id of all equal windows in the group."""
    out = [[np.full(len(p) - LENGTH + 1, doc) for p, doc in group] for group in groups]
    strings: list[list[Piece]] = [[(p, doc, [o]) for (p, doc), o in zip(group, owners, strict=True)] for group, owners in zip(groups, out, strict=True)]
    for level in range(1, LEVELS + 2):
        many = [s for s in strings if len(s) > PIECES]
        strings = [s for s in strings if 1 < len(s) <= PIECES]
        if many:  # at last single windows, of which no two in a string are equal
            strings += _dealt_again(many, level, single=level > LEVELS)
    strings = [s for s in strings if 1 < len(s) <= PIECES]
    strings.sort(key=lambda s: sum(len(p) + 1 for p, _, _ in s))
    batch: list = []
    held = 0
    for s in strings:
        size = sum(len(p) + 1 for p, _, _ in s) + 1
        if batch and held + size > BATCH_SYMBOLS:
            _settle(batch)
            batch, held = [], 0
        batch.append(s)
        held += size
    if batch:
        _settle(batch)
    return out


def _dealt_again(strings: list[list[Piece]], level: int, single: bool) -> list[list[Piece]]:
    """The strings' pieces cut and grouped by the keys of another level, or to single windows; equal pieces of a group become one."""
    pieces = [(k, p, doc, o) for k, s in enumerate(strings) for p, doc, o in s]
    offsets = np.cumsum([0, *(len(p) for _, p, _, _ in pieces)])
    parts: dict[tuple, dict[bytes, list[tuple[int, list[np.ndarray]]]]] = {}

    def put(group: tuple, p: bytes, doc: int, owners: list[np.ndarray]) -> None:
        parts.setdefault(group, {}).setdefault(p, []).append((doc, owners))

    if single:
        for k, p, doc, o in pieces:
            for w in range(len(p) - LENGTH + 1):
                put((k, p[w : w + LENGTH]), p[w : w + LENGTH], doc, [x[w : w + 1] for x in o])
    else:
        for keys, row, at, n in key_runs(np.frombuffer(b"".join(p for _, p, _, _ in pieces), np.uint8), offsets, level):
            for key, r, a, m in zip(keys.tolist(), row.tolist(), (at - offsets[row]).tolist(), n.tolist(), strict=True):
                k, p, doc, o = pieces[r]
                put((k, key), p[a : a + m + LENGTH - 1], doc, [x[a : a + m] for x in o])
    out = []
    for group in parts.values():
        out.append([(p, min(doc for doc, _ in same), [o for _, owners in same for o in owners]) for p, same in group.items()])
        for _, doc, owners in out[-1]:
            for o in owners:
                o[:] = doc
    return out


def _settle(strings: list[list[Piece]]) -> None:
    """Lower the owners of equal windows within each string to their least."""
    pieces = [p for s in strings for p in s]
    lengths = np.array([len(p) for p, _, _ in pieces])
    owner = window_owners(np.frombuffer(b"".join(p for p, _, _ in pieces), np.uint8), lengths, np.array([len(s) for s in strings]), np.array([doc for _, doc, _ in pieces]))
    begin = np.cumsum(lengths - LENGTH + 1) - (lengths - LENGTH + 1)
    for (p, _, owners), at in zip(pieces, begin, strict=True):
        for o in owners:
            o[:] = owner[at : at + len(p) - LENGTH + 1]


def window_owners(text: np.ndarray, lengths: np.ndarray, per: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For every window of pieces in a row, of which each string has the next ``per``: the least doc_id of the pieces of its string that hold the window, by the strings' suffix arrays."""
    ends_string = np.zeros(len(lengths), np.int64)
    ends_string[np.cumsum(per) - 1] = 1
    # each piece has a mark behind it (1), each string its end (0); bytes are 2 and above
    starts = np.cumsum(lengths + 1 + ends_string) - (lengths + 1 + ends_string)
    n = int(starts[-1] + lengths[-1] + 2)
    symbols = np.ones(n, np.int16)
    inside = ranges(starts, starts + lengths)
    symbols[inside] = text.astype(np.int16) + 2
    last = np.flatnonzero(ends_string)
    symbols[starts[last] + lengths[last] + 1] = 0
    bounds = np.concatenate([[0], starts[last] + lengths[last] + 2]).astype(np.int32)
    order = suffix_arrays(symbols, bounds)
    windows = lengths - LENGTH + 1
    window = np.zeros(n, bool)
    at = ranges(starts, starts + windows)
    window[at] = True
    order = order[window[order]]
    string_of = np.repeat(np.arange(len(per)), np.diff(bounds))[order]
    data = np.zeros(n + 8, np.uint8)
    data[inside] = text
    words = np.ndarray((n,), "<u8", data, strides=(1,))
    new = np.ones(len(order), bool)
    new[1:] = string_of[1:] != string_of[:-1]
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        w = words[order + k]
        new[1:] |= w[1:] != w[:-1]
    owner = np.zeros(n, np.int64)
    owner[at] = np.repeat(docs, windows)
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[order], begin)
    owner[order] = np.repeat(least, np.diff(np.append(begin, len(order))))
    return owner[at]


class Pieces:
    """Rows (key, single, piece, least, found) of whole keys, and for each window of each row the least doc_id that has it."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.key, self.single = (table.column(i).to_numpy() for i in (0, 1))
        self.data, self.offsets = flat(table.column(2))
        self.least = table.column(3).to_numpy()
        raw, ends = flat(table.column(4))
        self.found = raw.view(OCCURRENCE) if len(raw) else np.zeros(0, OCCURRENCE)
        self.times = np.diff(ends) // OCCURRENCE.itemsize
        self.sizes = np.diff(self.offsets)
        self.windows = self.sizes - LENGTH + 1
        self.base = np.cumsum(self.windows) - self.windows
        self.owner = np.repeat(self.least, self.windows)

    def alike(self, rows: np.ndarray) -> np.ndarray:
        """Whether the piece of each row is that of the row before it."""
        out = self.sizes[rows] == self.sizes[rows - 1]
        some = rows[out]
        out[out] = same_bytes(self.data, self.offsets[some], self.offsets[some - 1], self.sizes[some])
        return out

    def stream(self, before: tuple[bytes, int] | None) -> tuple[bytes, int] | None:
        """Single windows, of which equal ones stand side by side; ``before`` is the last window so far with its least doc_id."""
        rows = np.flatnonzero(self.single)
        if not len(rows):
            return before
        new = np.ones(len(rows), bool)
        new[1:] = ~self.alike(rows[1:])
        begin = np.flatnonzero(new)
        least = np.minimum.reduceat(self.least[rows], begin)
        if before and self.data[self.offsets[rows[0]] : self.offsets[rows[0] + 1]].tobytes() == before[0]:
            least[0] = min(least[0], before[1])
        self.owner[self.base[rows]] = np.repeat(least, np.diff(np.append(begin, len(rows))))
        return self.data[self.offsets[-2] :].tobytes(), int(least[-1])

    def settle(self, put_off: bool) -> np.ndarray:
        """The pieces of every key: equal ones are joined, and what is left of a key gets a suffix array.

        Returns which rows are ready; those of keys that need one aren't, if that is ``put_off``.
        """
        ready = np.ones(len(self.key), bool)
        rows = np.flatnonzero(~self.single)
        if not len(rows):
            return ready
        key = self.key[rows]
        other = np.ones(len(rows), bool)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        other[same] = ~self.alike(rows[same])
        lead, of = np.flatnonzero(other), np.cumsum(other) - 1
        first, least = rows[lead], np.minimum.reduceat(self.least[rows], lead)
        sizes, windows = self.sizes[first], self.windows[first]
        base = np.cumsum(windows) - windows
        owner = np.repeat(least, windows)
        begin = np.flatnonzero(np.concatenate([[True], key[lead][1:] != key[lead][:-1]]))
        n = np.diff(np.append(begin, len(lead)))
        if put_off:
            ready[rows] = np.repeat(n == 1, n)[of]
            n = np.minimum(n, 1)
        many = list(zip(begin[n > PIECES].tolist(), (begin + n)[n > PIECES].tolist(), strict=True))
        of_row = lambda k: (self.data[self.offsets[first[k]] : self.offsets[first[k] + 1]].tobytes(), int(least[k]))
        for (s, e), found in zip(many, least_owners([[of_row(k) for k in range(s, e)] for s, e in many]), strict=True):
            owner[base[s] : base[e - 1] + windows[e - 1]] = np.concatenate(found)
        some = (n > 1) & (n <= PIECES)
        start, per = begin[some], n[some]
        if len(per):
            symbols = np.add.reduceat(sizes[ranges(start, start + per)] + 1, np.cumsum(per) - per) + 1
            order = np.argsort(symbols, kind="stable")  # strings of one size take as many steps
            batch = np.cumsum(symbols[order]) // BATCH_SYMBOLS
            for which in np.split(order, np.flatnonzero(np.diff(batch)) + 1):
                own = ranges(start[which], start[which] + per[which])
                text = self.data[ranges(self.offsets[first[own]], self.offsets[first[own] + 1])]
                owner[ranges(base[own], base[own] + windows[own])] = window_owners(text, sizes[own], per[which], least[own])
        self.owner[ranges(self.base[rows], self.base[rows] + self.windows[rows])] = owner[ranges(base[of], base[of] + windows[of])]
        return ready

    def stretches(self, ready: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Where windows of documents are lost to a smaller doc_id, neighbours joined, of the rows that are ready."""
        of = np.repeat(np.arange(len(self.key)), self.times)
        at = np.flatnonzero(ready[of])
        for a in range(0, len(at), COMPARED):
            o, which = self.found[at[a : a + COMPARED]], of[at[a : a + COMPARED]]
            cells = ranges(self.base[which], self.base[which] + self.windows[which])
            row = np.repeat(np.arange(len(o)), self.windows[which])
            gone = self.owner[cells] < o["doc"][row]
            before = np.zeros(len(gone), bool)
            before[1:] = gone[:-1] & (row[1:] == row[:-1])
            begin = np.flatnonzero(gone & ~before)
            end = np.flatnonzero(gone & ~np.append(gone[1:] & before[1:], False))
            r = row[begin]
            shift = o["s"][r] - self.base[which][r]
            first, last = cells[begin] + shift, cells[end] + shift + LENGTH
            yield pa.RecordBatch.from_arrays([pa.array(o["doc"][r].copy()), pa.array(o["tag"][r].copy()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["doc", "tag", "s", "e"])


def _lost(pieces: DataFrame, partitions: int) -> DataFrame:
    """(doc, tag, s, e): stretches of documents that equal windows of documents with smaller ids cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        hard: list[pa.Table] = []  # whole keys with several pieces, until there are enough to share their steps
        held, last = 0, None
        for batch in chain(batches, [None]):
            if batch is not None:
                parts.append(batch)
                held += batch.nbytes
                if held < HELD_BYTES or not len(batch):
                    continue
            if any(len(p) for p in parts):
                table = pa.Table.from_batches(parts)
                key, single = (table.column(i).to_numpy() for i in (0, 1))
                # the last key may go on; single windows go on in any case
                end = len(key) if batch is None or single[-1] else 0 if (key == key[-1]).all() else int(np.flatnonzero(key != key[-1])[-1]) + 1
                parts, held = table.slice(end).to_batches(), 0
                if end:
                    now = table.slice(0, end)
                    own = Pieces(now)
                    ready = own.settle(put_off=True)
                    last = own.stream(last)
                    yield from own.stretches(ready)
                    hard.append(now.filter(pa.array(~ready)).combine_chunks())
            if hard and (batch is None or sum(t.nbytes for t in hard) > HARD_BYTES):
                own = Pieces(pa.concat_tables(hard))
                hard = []
                if len(own.key):
                    yield from own.stretches(own.settle(put_off=False))

    return pieces.repartition(partitions, "key").sortWithinPartitions("single", "key", "piece", "least").mapInArrow(run, LOST)


def lost_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, text and ``lost``, the (start, end) of its removed bytes, merged and ascending."""
    # the tag tells different texts of one doc_id apart
    tag = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").withColumn("tag", F.coalesce(tag, F.lit(0)))
    # sizes follow the input: about one key in sixteen bytes
    nbytes = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), nbytes >> 25, 1)
    buckets = partitions * max(1, (nbytes >> 4) // BUCKET_KEYS // partitions)
    digests = rows.where("doc IS NOT NULL").select("doc", "tag", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))
    # both written, so that Spark can split the join where one text has very many copies
    scratch = Scratch()
    digests = scratch.stored(digests)
    firsts = scratch.stored(digests.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last"))
    copies = stored(digests.join(firsts, "digest").where("doc > first").select("doc", "tag").distinct())
    scratch.clear()
    base = rows.where("doc IS NOT NULL")
    known = base.join(copies, ["doc", "tag"], "left_anti")
    shared = _shared_keys(_keys_by_bucket(known, buckets, _common_keys(base)), partitions, hot)
    shared = shared.groupBy("doc", "tag").agg(F.collect_list(F.struct("keys", "hot")).alias("shared"))
    lost = _lost(_pieces(base.join(shared, ["doc", "tag"])), partitions)
    lost = lost.groupBy("doc", "tag").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))).alias("found"))
    size = F.octet_length("text")
    spans = "array<struct<start:int,end:int>>"
    all_of_it = F.when(size >= LENGTH, F.array(F.struct(F.lit(0).alias("start"), size.alias("end")))).otherwise(F.array().cast(spans))
    whole = base.join(lost, ["doc", "tag"], "left").join(copies.withColumn("copy", F.lit(True)), ["doc", "tag"], "left")
    told = whole.select(F.col("doc").alias("doc_id"), "text", F.when(F.col("copy"), all_of_it).otherwise(F.coalesce(merged(F.col("found")), F.array().cast(spans))).alias("lost"))
    return told.unionByName(rows.where("doc IS NULL").select(F.col("doc").alias("doc_id"), "text", F.array().cast(spans).alias("lost")))


def merged(spans):
    """Ascending spans with those that overlap or touch made one."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def joined(column: pa.Array) -> pa.Array:
        start, end, ends = spans_of_rows(column)
        row = np.repeat(np.arange(len(column)), np.diff(ends))
        far = np.maximum.accumulate((row << 32) + end) - (row << 32)  # of all spans of the row so far
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > far[:-1])
        lead = np.flatnonzero(new)
        last = np.append(lead[1:], len(row)) - 1 if len(lead) else lead
        sizes = np.bincount(row[lead], minlength=len(column))
        runs = pa.StructArray.from_arrays([pa.array(start[lead].astype(np.int32)), pa.array(far[last].astype(np.int32))], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), runs)

    return joined(spans)


def spans_of_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the spans in a column of lists, and the n + 1 offsets of the rows' spans; null rows have none."""
    held = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return held.field("start").to_numpy().astype(np.int64), held.field("end").to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _kept_bytes(column: pa.Array, lost: pa.Array) -> Iterator[bytes]:
    data, offsets = flat(column)
    start, end, ends = spans_of_rows(lost)
    base = np.repeat(offsets[:-1], np.diff(ends))
    start, end = start + base, end + base
    for k in range(len(column)):
        s, e = ends[k], ends[k + 1]
        begins, stops = [offsets[k], *end[s:e]], [*start[s:e], offsets[k + 1]]
        yield b"".join([data[a:b].tobytes() for a, b in zip(begins, stops, strict=True)])


def kept_digests(spans: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    @F.arrow_udf("string")
    def digest(text: pa.Array, lost: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(x).hexdigest() for x in _kept_bytes(text, lost)])

    removed = F.aggregate("lost", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return spans.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("lost").cast("long").alias("n_spans"), digest("text", "lost").alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``, other columns as they are; what is left of a cut character goes too."""

    @F.arrow_udf("string")
    def kept(text: pa.Array, lost: pa.Array) -> pa.Array:
        return pa.array([x.decode(errors="ignore") for x in _kept_bytes(text, lost)])

    spans = lost_spans(docs).where(F.size("lost") > 0).select("doc_id", F.xxhash64("text").alias("hash"), "lost").dropDuplicates(["doc_id", "hash"])
    # the row is one struct on the way, so its columns may have any names
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"))
    text = F.when(F.col("lost").isNotNull(), kept("row.text", "lost")).otherwise(F.col("row.text"))
    return keyed.join(spans, ["doc_id", "hash"], "left").select(F.col("row").withField("text", text).alias("row")).select("row.*")
