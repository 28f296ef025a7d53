"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is ``SLOTS`` MinHash values of 16 bits over its distinct word shingles; the distance
of two signatures is the number of slots in which they differ. The slots are split into chunks. By pigeonhole
two signatures within ``MAX_ERRORS`` agree up to a chunk's share of errors in some chunk, so each signature
is filed under every chunk with every allowed choice of wrong slots masked out: no pair within the threshold
is missed. The threshold lies four standard deviations above the distance expected at a similarity of 0.75.

Documents with equal shingle sets are one node. A bucket's size and head (the member of least hash) come from
one aggregation that combines before its shuffle, and only buckets of two or more members go on. Each document
is confirmed on the full sets against the document that heads most of its buckets, which joins most copies: one
pair a document, so a group of copies costs links in proportion to its size.

What is left are pairs that share a bucket but no component. In such a bucket only the members outside its
largest component ask, all its members answer, and a pair belongs to the first bucket that its documents
share. ``_involved`` compares signatures and tells which documents have a pair in which bucket; ``_linked``
brings the full shingle sets of these documents to the bucket and confirms every such pair there, until its
two components are joined. Both emit rows in proportion to documents, never pairs. A bucket beyond ``DOCUMENTS``
or ``SHINGLES`` is dealt out as blocks of those that ask by blocks of those that answer, in many tasks.

Cases: null, empty and wordless texts have no shingles and link with nothing; a text of fewer words than a
shingle is one shingle. Rows with one doc_id are one document, each gets its own result row. Extra columns
are ignored. An empty table gives an empty table.
"""

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import shingle_sets
from .storage import Scratch, stored
from .words import mix

SLOTS, CHUNKS, MAX_ERRORS = 64, 16, 30
SHINGLE, PERCENT = 5, 75
#: of a block: documents when signatures are compared, shingles when sets are
DOCUMENTS, SHINGLES = 4096, 1 << 20
#: bits of a row's role in a block
ANSWERS, ASKS, MINOR = 1, 2, 4
_RNG = np.random.Generator(np.random.PCG64(6))
MULTIPLY = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
FEATURES = "doc_id long, n_shingles long, set_key binary, signature binary"


def masks() -> list[tuple[int, ...]]:
    """The slots that a key keeps, for every chunk and every choice of its allowed errors.

    With MAX_ERRORS = CHUNKS * a + c, the first c + 1 chunks allow a errors and the others a - 1: if all
    chunks had more, there would be more than MAX_ERRORS.
    """
    each = SLOTS // CHUNKS
    a, c = divmod(MAX_ERRORS, CHUNKS)
    out = []
    for k in range(CHUNKS):
        slots = range(k * each, (k + 1) * each)
        wrong = a if k <= c else a - 1
        out += [tuple(s for s in slots if s not in left) for left in combinations(slots, max(wrong, 0))]
    return out


MASKS = masks()


def signatures(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, SLOTS) 16-bit MinHash values of sets that aren't empty."""
    out = np.zeros((len(offsets) - 1, SLOTS), np.uint16)
    for k in range(SLOTS if len(out) else 0):
        out[:, k] = mix(np.minimum.reduceat(found * MULTIPLY[k] + ADD[k], offsets[:-1])) & np.uint64(0xFFFF)
    return out


def keys_of(sigs: np.ndarray) -> np.ndarray:
    """(rows, masks) 64-bit keys."""
    wide = sigs.astype(np.uint64)
    out = np.zeros((len(sigs), len(MASKS)), np.uint64)
    for i, kept in enumerate(MASKS):
        for s in kept:
            out[:, i] = out[:, i] << np.uint64(16) | wide[:, s]
        out[:, i] = mix(out[:, i] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return out


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a digest of the whole shingle set, and the signature (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, sigs = [], [], []
            for found, offsets in shingle_sets(batch.column(1), SHINGLE):
                n = np.diff(offsets)
                some = np.flatnonzero(n)
                sig = dict(zip(some.tolist(), signatures(found, np.append(offsets[some], len(found))), strict=True))
                counts += n.tolist()
                keys += [hashlib.blake2b(found[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                sigs += [sig[i].tobytes() if i in sig else None for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FEATURES)


def _filed(nodes: DataFrame) -> DataFrame:
    """(key, doc) for every node and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SLOTS)
            docs = np.repeat(batch.column(0).to_numpy(), len(MASKS))
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(sigs).ravel().view(np.int64)), pa.array(docs)], names=["key", "doc"])

    return nodes.select("doc", "signature").mapInArrow(run, "key long, doc long")


def _shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, found) of the wanted documents: their distinct shingle hashes, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            # a batch of results for each slice, so that a task never holds the sets of a whole batch of texts
            for found, offsets in shingle_sets(batch.column(1), SHINGLE):
                n = len(offsets) - 1
                ends = pa.py_buffer((offsets * found.itemsize).astype(np.int32))
                sets = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), sets], names=["doc", "found"])
                at += n

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(wanted, "doc", "left_semi")
    return texts.mapInArrow(run, "doc long, found binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        return pa.array(out, pa.bool_())

    side = lambda x: sets.select(F.col("doc").alias(x), F.col("found").alias(f"s{x}"))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").where(similar("sa", "sb")).select("a", "b")


def _dealt(rows: DataFrame, weight: Column, limit: int, scratch: Scratch) -> DataFrame:
    """``rows`` (key, doc, component, ...) of keys with several components, in blocks of about ``limit``: with m, q and role.

    A member asks if it is outside the largest component of its key. Block (m, q) of a key holds the m-th share
    of all members, which answer, and the q-th share of those that ask.
    """
    by = rows.groupBy("key", "component").agg(F.sum(weight).alias("w"))
    sizes = by.groupBy("key").agg(F.sum("w").alias("all"), F.max(F.struct("w", "component")).alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1")
    share = lambda w: F.ceil(w / F.lit(limit)).cast("int")
    # written, so that Spark can split a hot key's part of the join
    sizes = stored(sizes.select("key", F.col("most.component").alias("largest"), share(F.col("all")).alias("ms"), share(F.col("all") - F.col("most.w")).alias("qs")), scratch)
    spread, asks = F.xxhash64("doc"), F.col("component") != F.col("largest")
    own = lambda n: F.pmod(spread, F.col(n)).cast("int")
    place = lambda m, q, role: F.struct(m.alias("m"), q.alias("q"), role.cast("int").alias("role"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    answers = F.when(asks, ANSWERS + MINOR).otherwise(ANSWERS)
    alone = F.array(place(F.lit(0), F.lit(0), F.when(asks, answers + ASKS).otherwise(answers)))
    answering = F.transform(upto("qs"), lambda q: place(own("ms"), q, answers))
    asking = F.transform(upto("ms"), lambda m: place(m, own("qs"), F.lit(ASKS)))
    places = F.when((F.col("ms") == 1) & (F.col("qs") == 1), alone).when(asks, F.concat(answering, asking)).otherwise(answering)
    return rows.join(sizes, "key").withColumn("at", F.explode(places)).select(*rows.columns, F.col("at.m").alias("m"), F.col("at.q").alias("q"), F.col("at.role").alias("role"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, which are in order of their first three columns, cut where a group ends."""
    whole = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        group = [batch.column(i).to_numpy() for i in range(3)]
        if rest and any(rest[-1].column(i)[-1].as_py() != x[0] for i, x in enumerate(group)):
            yield whole(rest)
            rest = []
        other = np.logical_or.reduce([x != x[-1] for x in group])
        edge = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if edge:
            yield whole([*rest, batch.slice(0, edge)])
            rest = []
        rest.append(batch.slice(edge))
    if rest:
        yield whole(rest)


class Bucket:
    """One group of rows (key, m, q, role, doc, component, n, signature): the pairs that belong to its bucket."""

    def __init__(self, key: int, role: np.ndarray, docs: np.ndarray, comps: np.ndarray, n: np.ndarray, sigs: np.ndarray, keys: np.ndarray):
        self.docs, self.comps, self.n, self.sigs, self.keys = docs, comps.copy(), n, sigs, keys
        self.asking, self.answering = np.flatnonzero(role & ASKS), np.flatnonzero(role & ANSWERS)
        self.mask = int((keys == key).any(0).argmax())
        self.minor = role & MINOR > 0

    def partners(self, x: int) -> np.ndarray:
        """The rows that ``x`` has to be compared with, of components that aren't joined yet."""
        there = self.answering
        # of two that ask, the one with the smaller doc asks
        there = there[(self.comps[there] != self.comps[x]) & (~self.minor[there] | (self.docs[there] > self.docs[x]))]
        there = there[100 * np.minimum(self.n[there], self.n[x]) >= PERCENT * np.maximum(self.n[there], self.n[x])]
        there = there[(self.sigs[there] != self.sigs[x]).sum(1) <= MAX_ERRORS]
        return there[(self.keys[there] == self.keys[x]).argmax(1) == self.mask]

    def joined(self, x: int, y: int) -> None:
        self.comps[self.comps == self.comps[y]] = self.comps[x]


def _buckets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Bucket]]:
    """The groups of a batch with where they begin and end."""
    key, m, q, role, docs, comps, n = (batch.column(i).to_numpy() for i in range(7))
    sigs = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint16).reshape(-1, SLOTS)
    keys = keys_of(sigs).view(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (m[1:] != m[:-1]) | (q[1:] != q[:-1])]))
    for s, e in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
        if e - s > 1:
            yield s, e, Bucket(key[s], role[s:e], docs[s:e], comps[s:e], n[s:e], sigs[s:e], keys[s:e])


GROUPED = ["key", "m", "q", "role", "doc", "component", "n_shingles", "signature"]


def _involved(members: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, doc) of documents that have a pair to confirm in a bucket; members: key, doc, component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _blocks(batches):
            keys, docs = [], []
            for s, _, bucket in _buckets(whole):
                some = np.zeros(len(bucket.docs), bool)
                for x in bucket.asking:
                    there = bucket.partners(x)
                    some[there] = True
                    some[x] |= len(there) > 0
                if some.any():
                    docs.append(np.unique(bucket.docs[some]))
                    keys.append(np.full(len(docs[-1]), whole.column(0)[s].as_py()))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(docs))], names=["key", "doc"])

    rows = _dealt(members, F.lit(1), DOCUMENTS, scratch).join(nodes.select("doc", "n_shingles", "signature"), "doc").select(*GROUPED)
    return rows.repartition("key", "m", "q").sortWithinPartitions("key", "m", "q").mapInArrow(run, "key long, doc long").distinct()


def _linked(members: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join the components of members (key, doc, component) wherever a pair of a bucket is similar enough."""

    def links(bucket: Bucket, found: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(x) for x in found])
        begin = np.cumsum(sizes) - sizes
        _, code = np.unique(np.concatenate(found), return_inverse=True)
        own = np.zeros(code.max() + 1, bool)
        for x in bucket.asking:
            there = bucket.partners(x)
            if not len(there):
                continue
            mine = code[begin[x] : begin[x] + sizes[x]]
            own[mine] = True
            upto = np.cumsum(sizes[there])
            at = np.repeat(begin[there] - (upto - sizes[there]), sizes[there]) + np.arange(upto[-1])
            common = np.add.reduceat(own[code[at]].astype(np.int64), upto - sizes[there])
            own[mine] = False
            for y in there[100 * common >= PERCENT * (sizes[x] + sizes[there] - common)]:
                if bucket.comps[y] != bucket.comps[x]:
                    yield int(bucket.docs[x]), int(bucket.docs[y])
                    bucket.joined(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _blocks(batches):
            out = [pair for s, e, bucket in _buckets(whole) for pair in links(bucket, [np.frombuffer(x.as_buffer(), np.uint64) for x in whole.column(8).slice(s, e - s)])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows = _dealt(members.join(nodes, "doc").select("key", "doc", "component", "n_shingles", "signature"), F.col("n_shingles"), SHINGLES, scratch)
    rows = rows.join(sets, "doc").select(*GROUPED, "found")
    return rows.repartition("key", "m", "q").sortWithinPartitions("key", "m", "q").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    features = stored(document_features(docs))
    some = features.where("n_shingles > 0")
    nodes = stored(some.groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("doc"), F.min("signature").alias("signature")))
    usable = nodes.where("doc IS NOT NULL").select("doc", "n_shingles", "signature")
    filed = _filed(usable)
    heads = filed.groupBy("key").agg(F.min_by("doc", F.xxhash64("doc")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    scratch = Scratch()
    members = scratch.stored(filed.join(scratch.stored(heads), "key"))
    sets = scratch.stored(_shingled(docs, members.select("doc").distinct()))

    # first each document with the head of most of its buckets
    shared = members.where("doc <> head").groupBy("doc", "head").agg(F.count(F.lit(1)).alias("n"))
    nearest = shared.groupBy("doc").agg(F.max(F.struct("n", "head")).alias("most")).select(F.col("doc").alias("b"), F.col("most.head").alias("a"))
    found = components(_confirmed(nearest, sets))
    labels = members.select("key", "doc").join(found.withColumnRenamed("id", "doc"), "doc", "left")
    labelled = scratch.stored(labels.select("key", "doc", F.coalesce("component", "doc").alias("component")))
    involved = scratch.stored(_involved(labelled, usable, scratch).join(labelled, ["key", "doc"]))
    found = components(found.toDF("a", "b").unionByName(_linked(involved, usable, sets, scratch)))
    scratch.clear()

    classes = nodes.select("set_key", "doc").join(found.withColumnRenamed("id", "doc"), "doc", "left").select("set_key", F.coalesce("component", "doc").alias("component_id"))
    out = features.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
