"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

Every byte has a learned vector; ``filters`` learned filters slide over ``taps`` bytes with ReLU. Chunks of
``2 * HALF`` bytes overlap by half and cover the whole document, the last one too; each filter is max-pooled
within each chunk. The mean and the maximum over a document's chunks go through one logistic unit, which
gives one probability.

The model is fitted on a sample of labelled rows: of each class at most ``per_class`` rows and ``class_bytes`` bytes of
text, in the order of the hashes of doc_id; a text that doesn't fit any more is passed over. Every visit sees the
whole text, as every document is scored over its whole text. A step has as many texts as ``batch`` and ``STEP_BYTES``
allow, one at least, and works through them in blocks, so the driver needs some 40 bytes for each byte of the longest
step. The model is a few kilobytes and goes to the tasks with the code. Both classes count equally in the loss.

Cases: a null or empty text is scored as one chunk of padding; equal texts get equal scores; labels of
documents that aren't in the table are ignored, as are null labels; of contradicting labels of a document the
lower one counts; with no or only one class of labels the model gives the share of label 1 (0.5 without
any). Repeated rows are scored one by one; extra columns are kept, but for those named held_out, score or predicted,
which are replaced. An empty table gives an empty table.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import slices

HALF = 256
PER_CLASS, CLASS_BYTES = 2000, 8 << 20
STEP_BYTES = 1 << 20
THRESHOLD = 0.7
BLOCK = 1 << 16
FOLDS, HELD_OUT = 4, 2


@dataclass
class Model:
    """embed: (256, e), filters: (taps * e, f), bias: (f,), out: (2 f,), offset."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float

    @property
    def taps(self) -> int:
        return len(self.filters) // self.embed.shape[1]


def unfolded(data: np.ndarray, model: Model) -> np.ndarray:
    """At each of len(data) - taps + 1 places the vectors of the bytes under the filters."""
    e = model.embed.shape[1]
    vectors = model.embed[data]
    places = len(data) - model.taps + 1
    return np.lib.stride_tricks.as_strided(vectors, (places, model.taps * e), (e * 4, 4))


def laid_out(data: np.ndarray, lengths: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The documents with ``pad`` zeros behind each, where their half chunks begin and end, and the halves of each document."""
    sizes = np.maximum(lengths, 1)
    starts = np.concatenate([[0], np.cumsum(sizes + pad)])
    padded = np.zeros(starts[-1] + pad, np.uint8)
    padded[np.arange(len(data)) + np.repeat(starts[:-1] - (np.cumsum(lengths) - lengths), lengths)] = data
    halves = -(-sizes // HALF)
    upto = np.cumsum(halves)
    at = np.repeat(starts[:-1], halves) + (np.arange(upto[-1]) - np.repeat(upto - halves, halves)) * HALF
    return padded, at, np.minimum(at + HALF, np.repeat(starts[:-1] + sizes, halves)), halves


def pooled_halves(data: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per half chunk the maximum of each filter, and the number of halves of each document."""
    pad = model.taps - 1
    padded, at, ends, halves = laid_out(data, lengths, pad)
    out = np.zeros((len(at), len(model.bias)), np.float32)
    a = 0
    while a < len(at):  # in blocks, as the unfolded vectors take many times the bytes
        b = max(a + 1, int(np.searchsorted(ends, at[a] + BLOCK, "right")))
        x = unfolded(padded[at[a] : ends[b - 1] + pad], model) @ model.filters
        edges = np.stack([at[a:b], ends[a:b]], 1).ravel() - at[a]
        out[a:b] = np.maximum.reduceat(np.concatenate([x, x[-1:]]), edges, axis=0)[::2]
        a = b
    return np.maximum(out + model.bias, 0), halves


def chunks_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The two halves of every overlapping chunk (one half twice where a document has no more), chunks by document, and where they begin."""
    n = np.maximum(counts - 1, 1)
    begin = np.cumsum(counts) - counts
    upto = np.cumsum(n)
    left = np.arange(upto[-1]) + np.repeat(begin - (upto - n), n)
    right = np.minimum(left + 1, np.repeat(begin + counts - 1, n))
    return left, right, n, upto - n


def score_documents(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """A probability for each document of flat byte arrays."""
    lengths = np.diff(offsets)
    halves, counts = pooled_halves(data, lengths, model)
    left, right, n, begin = chunks_of(counts)
    chunks = np.maximum(halves[left], halves[right])
    mean = np.add.reduceat(chunks.astype(np.float64), begin, axis=0) / n[:, None]
    top = np.maximum.reduceat(chunks, begin, axis=0)
    z = np.concatenate([mean, top], 1) @ model.out.astype(np.float64) + model.offset
    return 1 / (1 + np.exp(-z))


def strongest(x: np.ndarray, at: np.ndarray, ends: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each half chunk and filter the highest response and its place, block by block."""
    where, top = np.empty((len(at), filters.shape[1]), np.int64), np.empty((len(at), filters.shape[1]), np.float32)
    for a in range(0, len(at), BLOCK // HALF):
        own = slice(a, a + BLOCK // HALF)
        base = at[a]
        flat = x[base : ends[own][-1]] @ filters
        spots = np.minimum(at[own, None] + np.arange(HALF), ends[own, None] - 1) - base
        best = np.take_along_axis(spots, flat[spots].argmax(1), 1)
        where[own], top[own] = best + base, flat[best, np.arange(filters.shape[1])]
    return where, top


def fit(texts: list[bytes], labels: list[int], width: int = 8, taps: int = 6, filters: int = 16, passes: int = 8, least_steps: int = 400, batch: int = 64, seed: int = 5) -> Model:
    """Adam on the logistic loss, with both classes weighing alike."""
    rng = np.random.Generator(np.random.PCG64(seed))
    model = Model(rng.normal(0, 0.5, (256, width)).astype(np.float32), rng.normal(0, (taps * width) ** -0.5, (taps * width, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.1, 2 * filters).astype(np.float32), 0.0)
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        model.out[:] = 0
        model.offset = float(np.log(share / (1 - share)))
        return model
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    docs = [np.frombuffer(t, np.uint8) for t in texts]
    params = [model.embed, model.filters, model.bias, model.out, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    # a small sample is seen more often, as far as its bytes allow
    mean_bytes = max(sum(map(len, docs)) / len(docs), 1)
    visits = max(passes * len(y), min(least_steps * batch, int(passes * 2 * CLASS_BYTES / mean_bytes)))
    order: list[int] = []
    seen = step = 0
    while seen < visits:
        if len(order) < batch:
            order += rng.permutation(len(y)).tolist()
        upto = np.cumsum([len(docs[r]) for r in order[:batch]])
        n = max(int(np.searchsorted(upto, STEP_BYTES, "right")), 1)
        rows, order = order[:n], order[n:]
        seen, step = seen + n, step + 1
        own = [docs[r] for r in rows]
        data, at, ends, counts = laid_out(np.concatenate(own), np.array([len(x) for x in own]), taps - 1)
        x = unfolded(data, model)
        where, top = strongest(x, at, ends, model.filters)
        halves = np.maximum(top + model.bias, 0)
        left, right, n, begin = chunks_of(counts)
        chunks = np.maximum(halves[left], halves[right])
        mean = np.add.reduceat(chunks, begin, axis=0) / n[:, None]
        peak = np.maximum.reduceat(chunks, begin, axis=0)
        feats = np.concatenate([mean, peak], 1).astype(np.float32)
        p = 1 / (1 + np.exp(-(feats @ model.out + params[4][0])))
        dz = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
        of = np.repeat(np.arange(len(rows)), n)
        top = chunks == peak[of]
        share = np.add.reduceat(top.astype(np.float32), begin, axis=0)  # equal peaks share their gradient
        dchunks = dz[of, None] * (model.out[:filters] / n[of, None].astype(np.float32) + model.out[filters:] * top / share[of])
        dh = np.zeros_like(halves)
        from_left = halves[left] >= halves[right]
        np.add.at(dh, left, dchunks * from_left)
        np.add.at(dh, right, dchunks * ~from_left)
        dh *= halves > 0
        dfilters = np.einsum("hf,hfk->kf", dh, x[where.ravel()].reshape(*where.shape, -1))
        dx = (dh[..., None] * model.filters.T[None]).reshape(-1, width)
        dembed = np.zeros_like(model.embed)
        np.add.at(dembed, data[(where.ravel()[:, None] + np.arange(taps)).ravel()], dx)
        grads = [dembed, dfilters, dh.sum(0), feats.T @ dz, np.array([dz.sum()])]
        rate = 0.01 * max(1 - seen / (visits + batch), 0)
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    model.offset = float(params[4][0])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> list[tuple[int, bytes, int]]:
    """(doc_id, text, quality) of the sample: labelled rows outside the held-out fold, bounded in rows and bytes."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id")
    chosen = [r for q in (0, 1) for r in usable.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class).collect()]
    if not chosen:
        return []
    spark = docs.sparkSession
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")

    def matching(ids: list[int], what: Column) -> dict[int, int | bytes]:
        """``what`` of the documents with these ids, at most 2 * per_class; of several the least."""
        wanted = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(what.alias("what"))
        return {r["doc_id"]: r["what"] for r in found.collect()}

    sizes = matching([r["doc_id"] for r in chosen], F.octet_length(F.min("text")))
    quality, left = {}, {0: class_bytes, 1: class_bytes}
    for r in chosen:
        size = sizes.get(r["doc_id"])
        if size is not None and size <= left[r["quality"]]:
            left[r["quality"]] -= size
            quality[r["doc_id"]] = r["quality"]
    texts = matching(list(quality), F.min("text")) if quality else {}
    return [(i, bytes(texts[i]), quality[i]) for i in sorted(texts)]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    rows = sampled(docs, labels, per_class, class_bytes)
    return fit([text for _, text, _ in rows], [quality for _, _, quality in rows])


def quality_score(text: Column, model: Model) -> Column:
    """The probability of label 1 for each text."""

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            found = [score_documents(data, offsets, model) for _, _, data, offsets in slices(part)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return scored(text)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    kept = docs.drop("held_out", "score", "predicted")
    out = kept.withColumn("score", quality_score(F.col("text"), model))
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
