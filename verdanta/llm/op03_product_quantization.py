"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, exact rerank.

Equal vectors are one node. Nodes are filed in the coarse list of their nearest centroid, with the residual
coded in subspaces of ``SUB`` dimensions by ``CODES`` codewords each, and with the length of what the code
leaves out. Every node is also a query in its own list and in each list whose border, the plane between the two
centroids, lies within half the link radius. Two linked nodes of different lists stand on two sides of such a
plane and at most a link radius apart, so at least one of them is that near to it: every link is met, whatever
the vectors look like. A link that only one side meets counts for both; each member brings the lists that it
probes itself, so that is known. In a list, asymmetric distances come from one table per query and subspace; a
member whose table distance is within the link radius plus the length its code leaves out is a candidate (no
link can be lost here), and candidates are confirmed by the cosine in double precision.

The number of lists is ``2 * sqrt(n)``, so work grows as n to the power 1.5. A list of more than ``BLOCK`` members is
cut into blocks, which are separate groups. Groups emit counts and a spanning forest of
their links, never the pairs, so a large group of near copies costs rows in proportion to its size.

The centroids are fitted on ``PER_LIST`` nodes per list (``SAMPLE`` at least) and the codewords on at most ``SAMPLE``; the
samples of all lengths together have about ``SAMPLE_BYTES``, whatever the table's size. Many centroids are fitted in two
levels, means of means. Every vector is filed and compared; its list is found once and written.

Cases: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows with a
null vec_id. Vectors of different lengths don't link; each length has a quantizer and lists of its own, and all
go through the same jobs. Repeated rows are vectors of their own. Labels and extra columns are ignored. An empty table gives an empty table.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import Scratch, stored

COSINE = 0.95
SUB, CODES = 8, 256
PER_LIST, SAMPLE, SAMPLE_BYTES = 8, 1 << 14, 64 << 20
ONE_LEVEL, PLANE = 1024, 1 << 21
BLOCK, QUERIES, MEMBERS, RERANKED = 1 << 14, 1024, 256, 1 << 15
FILED = "list int, block int, query boolean, node long, rep long, copies long, vec binary, codes binary, rest double, own int, probed binary"


@dataclass
class Quantizer:
    """centroids (lists, dim), and codebooks (parts, codes, SUB or less)."""

    centroids: np.ndarray
    codebooks: list[np.ndarray]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, i : i + SUB] for i in range(0, x.shape[1], SUB)]


@dataclass
class Index:
    """A quantizer per length of vectors, and the number of the first of its lists."""

    models: dict[int, Quantizer]

    def __post_init__(self):
        self.lengths = sorted(self.models)
        self.sizes = [len(self.models[k].centroids) for k in self.lengths]
        self.firsts = [0, *np.cumsum(self.sizes).tolist()]

    def first(self, length: int) -> int:
        return self.firsts[self.lengths.index(length)]

    def of_list(self, number: int) -> tuple[Quantizer, int]:
        """The quantizer that a list belongs to, and the list's number there."""
        k = int(np.searchsorted(self.firsts, number, "right")) - 1
        return self.models[self.lengths[k]], number - self.firsts[k]

    def step(self) -> int:
        """Rows whose distances to all centroids are held at once."""
        return max(16, min(QUERIES, PLANE // max(self.sizes)))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x the nearest row of y, in blocks."""
    half = (y * y).sum(1) / 2
    return np.concatenate([(half - x[i : i + QUERIES] @ y.T).argmin(1) for i in range(0, len(x), QUERIES)])


def k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most ``k`` means; an empty one keeps its place. Very many are means of the parts that fewer means make."""
    x = x.astype(np.float32)
    if k > ONE_LEVEL and len(x) > k:
        own = nearest(x, k_means(x, int(k**0.5)).astype(np.float32))
        parts = [x[own == g] for g in np.unique(own)]
        return np.concatenate([k_means(part, max(1, round(k * len(part) / len(x)))) for part in parts])
    means = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, means)
        order = np.argsort(own, kind="stable")
        names, begin = np.unique(own[order], return_index=True)
        means[names] = np.add.reduceat(x[order], begin, axis=0) / np.diff(np.append(begin, len(x)))[:, None]
    return means.astype(np.float64)


def fit(x: np.ndarray, lists: int) -> Quantizer:
    """From unit vectors; without any, one list around zero."""
    if not len(x):
        model = Quantizer(np.zeros((1, x.shape[1])), [])
        model.codebooks = [np.zeros((1, part.shape[1])) for part in model.parts(model.centroids)]
        return model
    model = Quantizer(k_means(x, lists), [])
    some = x[:SAMPLE]
    model.codebooks = [k_means(part, CODES) for part in model.parts(some - model.centroids[nearest(some, model.centroids)])]
    return model


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as the edges (a, b) do, at most one per node."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    least = np.arange(len(ids))
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, least[x], low)
        np.minimum.at(new, least[y], low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    far = least != np.arange(len(ids))
    return ids[far], ids[least[far]]


NODES = "node long, rep long, copies long, dim int, vec binary"


def by_length(batch: pa.RecordBatch, dtype: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each length of a batch of NODES, with their vectors."""
    lengths = batch.column(3).to_numpy()
    for dim in np.unique(lengths).tolist():
        own = batch if (lengths == dim).all() else batch.filter(pa.array(lengths == dim))
        yield dim, own, np.frombuffer(b"".join(own.column(4).to_pylist()), dtype).reshape(len(own), dim)


def _assigned(nodes: DataFrame, index: Index, dtype: str) -> DataFrame:
    """The nodes with the number of the list of their nearest centroid."""
    shared = nodes.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for at in range(0, len(whole), index.step()):
                for dim, own, raw in by_length(whole.slice(at, index.step()), dtype):
                    found = squared(unit(raw), index.models[dim].centroids).argmin(1) + index.first(dim)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found.astype(np.int32))], names=[*own.schema.names, "own"])

    return nodes.select("node", "rep", "copies", "dim", "vec").mapInArrow(run, f"{NODES}, own int")


def _filed(nodes: DataFrame, index: Index, dtype: str, radius: float, blocks: dict[int, int]) -> DataFrame:
    """Assigned nodes as members and queries, dealt to the blocks of each list."""
    shared = nodes.sparkSession.sparkContext.broadcast((index, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, blocks = shared.value
        sizes = np.array([blocks.get(c, 0) for c in range(index.firsts[-1])])
        for whole in batches:
            for at in range(0, len(whole), index.step()):
                for dim, batch, raw in by_length(whole.slice(at, index.step()), dtype):
                    model, first = index.models[dim], index.first(dim)
                    n = sizes[first : first + len(model.centroids)]
                    node, rep, copies = (batch.column(i).to_numpy() for i in range(3))
                    own = batch.column(5).to_numpy().astype(np.int64) - first
                    x = unit(raw)
                    rows = np.arange(len(x))
                    d = squared(x, model.centroids)
                    residual = x - model.centroids[own]
                    codes = np.stack([nearest(p, book) for p, book in zip(model.parts(residual), model.codebooks, strict=True)], 1)
                    coded = np.concatenate([book[codes[:, m]] for m, book in enumerate(model.codebooks)], 1)
                    rest = np.sqrt(((residual - coded) ** 2).sum(1))
                    # twice the distance of the centroids times that to the plane, with room for rounding
                    near = (d - d[rows, own][:, None] <= radius * np.sqrt(squared(model.centroids[own], model.centroids)) + 1e-9) & (n > 0)
                    near[rows, own] = True
                    q, c = np.nonzero(near)
                    probed = [(p + first).astype("<i4").tobytes() for p in np.split(c, np.searchsorted(q, rows[1:]))]
                    times = n[c]
                    q, c = np.repeat(q, times), np.repeat(c, times)
                    nth = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                    spread = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    lists, block = np.concatenate([own, c]) + first, np.concatenate([spread % n[own], nth])
                    query, of = np.repeat([False, True], [len(x), len(q)]), np.concatenate([rows, q])
                    asked = pa.array(np.where(query, -1, of), mask=query)  # queries need neither codes nor probed lists
                    vec = pa.array([r.tobytes() for r in raw], pa.binary()).take(pa.array(of))
                    code = pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary()).take(asked)
                    columns = [pa.array(lists.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(query), pa.array(node[of]), pa.array(rep[of]), pa.array(copies[of]), vec, code, pa.array(rest[of]), pa.array((own[of] + first).astype(np.int32)), pa.array(probed, pa.binary()).take(asked)]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FILED.split(", ")])

    return nodes.mapInArrow(run, FILED)


def candidates(x: np.ndarray, codes: np.ndarray, rest: np.ndarray, model: Quantizer, c: int, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) pairs whose table distance doesn't exclude a link, by blocks of members."""
    residual = x - model.centroids[c]
    tables = [squared(book, part).astype(np.float32) for part, book in zip(model.parts(residual), model.codebooks, strict=True)]
    limit = ((radius + rest) ** 2 * (1 + 1e-5) + 1e-5).astype(np.float32)
    for at in range(0, len(codes), MEMBERS):
        own = codes[at : at + MEMBERS]
        d = tables[0][own[:, 0]]
        for m, table in enumerate(tables[1:], 1):
            d += table[own[:, m]]
        j, i = np.nonzero(d <= limit[at : at + MEMBERS, None])
        yield i, j + at


def _compared(filed: DataFrame, index: Index, dtype: str, radius: float, cosine: float) -> DataFrame:
    """Counts of links (node, n), to be added up by node, and links (a, b) that span each group's."""
    shared = filed.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        key, parts, members = None, [], None
        for batch in batches:
            lists, block, query = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero((lists[1:] != lists[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1
            for s, e in zip([0, *edges], [*edges, len(batch)], strict=True):
                if s == e:
                    continue
                if (lists[s], block[s]) != key:
                    key, parts, members = (lists[s], block[s]), [], None
                if not query[s]:
                    parts.append(batch.slice(s, e - s))
                    continue
                if parts and members is None:
                    members = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    members = arrays(members), np.frombuffer(b"".join(members.column(7).to_pylist()), np.uint8).reshape(len(members), -1), members.column(8).to_numpy(), probed_by(members)
                if members is not None:
                    for at in range(s, e, QUERIES):
                        yield from compare(index, int(key[0]), members, batch.slice(at, min(QUERIES, e - at)))

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        x = unit(np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype).reshape(len(batch), -1))
        return x, *(batch.column(i).to_numpy() for i in (3, 4, 5))

    def probed_by(members: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(list, member) of all lists that the members probe, in order."""
        found = [np.frombuffer(p, "<i4") for p in members.column(10).to_pylist()]
        lists, who = np.concatenate(found), np.repeat(np.arange(len(found)), [len(p) for p in found])
        order = np.argsort(lists, kind="stable")
        return lists[order], who[order]

    def compare(index: Index, c: int, members: tuple, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model, here = index.of_list(c)
        (y, m_node, m_rep, m_copies), codes, rest, (lists, who) = members
        x, q_node, q_rep, q_copies = arrays(batch)
        own = batch.column(9).to_numpy()
        linked: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in candidates(x, codes, rest, model, here, radius):
            apart = q_node[i] != m_node[j]
            i, j = i[apart], j[apart]
            for k in range(0, len(i), RERANKED):
                u, v = i[k : k + RERANKED], j[k : k + RERANKED]
                near = np.einsum("nd,nd->n", x[u], y[v]) >= cosine
                linked.append((u[near], v[near]))
        i, j = (np.concatenate([p[k] for p in linked]) if linked else np.zeros(0, np.int64) for k in (0, 1))
        counts = np.bincount(i, m_copies[j], len(x)).astype(np.int64)
        # members that don't meet the link as queries of the other one's list
        back = np.zeros(len(y), np.int64)
        for other in np.unique(own[i]):
            if other != c:
                meets = np.zeros(len(y), bool)
                meets[who[np.searchsorted(lists, other) : np.searchsorted(lists, other, "right")]] = True
                once = (own[i] == other) & ~meets[j]
                back += np.bincount(j[once], q_copies[i[once]], len(y)).astype(np.int64)
        a, b = forest(q_rep[i], m_rep[j]) if len(i) else (np.zeros(0, np.int64),) * 2
        some, more = counts > 0, back > 0
        n = int(some.sum() + more.sum())
        if not n + len(a):
            return
        counted = np.arange(n + len(a)) < n
        both = lambda u, v, mask: pa.array(np.concatenate([u, v]).astype(np.int64), mask=mask)
        none = np.zeros(len(a), np.int64), np.zeros(n, np.int64)
        node, times = np.concatenate([q_node[some], m_node[more]]), np.concatenate([counts[some], back[more]])
        yield pa.RecordBatch.from_arrays([both(node, none[0], ~counted), both(times, none[0], ~counted), both(none[1], a, counted), both(none[1], b, counted)], names=["node", "n", "a", "b"])

    dealt = filed.repartition("list", "block").sortWithinPartitions("list", "block", "query")
    return dealt.mapInArrow(run, "node long, n long, a long, b long")


def _fitted(nodes: DataFrame, dtype: str) -> Index:
    """Quantizers of all lengths, on a sample of about SAMPLE_BYTES; the driver holds a number per length and the sample."""
    counts = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}
    lists = {dim: max(1, int(2 * n**0.5)) for dim, n in counts.items()}
    rows = {dim: min(n, max(SAMPLE, PER_LIST * lists[dim])) for dim, n in counts.items()}
    scale = min(1.0, SAMPLE_BYTES / max(sum(dim * n * np.dtype(dtype).itemsize for dim, n in rows.items()), 1))
    shares = nodes.sparkSession.createDataFrame([(dim, scale * n / counts[dim]) for dim, n in rows.items()], "dim int, share double")
    chosen = F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample: dict[int, list[tuple[int, bytes]]] = {dim: [] for dim in counts}
    for r in nodes.join(F.broadcast(shares), "dim").where(chosen).select("dim", F.xxhash64("vec").alias("hash"), "vec").collect():
        sample[r["dim"]].append((r["hash"], bytes(r["vec"])))
    models = {}
    for dim, some in sample.items():
        x = np.frombuffer(b"".join(v for _, v in sorted(some)), dtype).reshape(len(some), dim)
        models[dim] = fit(unit(x) if len(x) else x, min(lists[dim], max(1, len(x) // PER_LIST)))
    return Index(models)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    double = "double" in dict(vectors.dtypes)["embedding"]
    dtype = "<f8" if double else "<f4"
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(usable, F.col("embedding")).alias("e"))
    none = rows.where("e IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().astype(dtype).tobytes()
            ends = (batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()) * np.dtype(dtype).itemsize
            vec = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column(0), vec], names=["vec_id", "vec"])

    scratch = Scratch()
    vecs = scratch.stored(rows.where("e IS NOT NULL").mapInArrow(packed, "vec_id long, vec binary"))
    size = F.octet_length("vec") / F.lit(np.dtype(dtype).itemsize)
    distinct = vecs.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    first = Scratch()
    nodes = first.stored(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", size.cast("int")))
    index = _fitted(nodes, dtype)
    if not index.lengths:
        return none.withColumn("kept", F.lit(True))
    nodes = scratch.stored(_assigned(nodes, index, dtype))
    first.clear()
    radius = (2 - 2 * cosine) ** 0.5
    # one row per list: as many as there are centroids in the sample's model
    blocks = {r["own"]: -(-r["count"] // BLOCK) for r in nodes.groupBy("own").count().collect()}
    found = scratch.stored(_compared(_filed(nodes, index, dtype, radius, blocks), index, dtype, radius, cosine))
    counts = found.where("node IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    classes = components(found.where("node IS NULL").select("a", "b"))
    told = nodes.join(counts, "node", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    told = told.select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = stored(vecs.join(told, "vec").select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id")), then=scratch)
    return none.unionByName(out).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
