"""Byte-level BPE with reuse of content-defined chunks, repaired at the joins.

A rolling hash over 32 bytes cuts every text where the hash's top bits are zero, so passages that documents
share are cut alike wherever they stand. A chunk is encoded once as long as its worker remembers it: of the chunks
encoded or used before, the latest ``KEPT_BYTES`` at least are kept, twice that at most. A
chunk encoded alone is wrong near its ends. At a join, the bytes from the last safe place before it to the
first safe place after it are encoded again; safe is a single space between two characters that aren't white
space, where the vocabulary's pre-tokenizer always parts tokens. The chunk's own tokens must have a boundary
at that place too; where they don't agree, or a chunk holds no safe place, the stretch grows to the next
chunk, up to the whole document. Decoding looks every id's bytes up and joins them.

The map runs where the texts are read: no text is shuffled, memory is bounded by the slice of texts in hand
and the kept chunks, and a lost executor's tasks are run again alone.

Cases: a null or empty text has no ids. Texts that may hold a special token's string go to the tokenizers
library as a whole. Repeated rows are encoded for each row. Extra columns are ignored. An empty table gives an empty table.
"""

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import slices
from .wordpieces import byte_of_symbol

CHUNK_BITS = 9
KEPT_BYTES = 16 << 20
GEAR = np.random.Generator(np.random.PCG64(10)).integers(0, 1 << 32, 256, dtype=np.uint32)
#: pre-tokens of byte-level BPE: fixed values of the vocabulary
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

#: first bytes of characters that are never white space
VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = VISIBLE[0xC3:0xE0] = VISIBLE[0xE4:0xEE] = VISIBLE[0xF0:0xF5] = True


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of the last 32 bytes, by doubling the stretch five times."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def safe_places(data: np.ndarray) -> np.ndarray:
    """Where a space stands between two visible characters."""
    out = np.zeros(len(data), bool)
    if len(data) < 3:
        return out
    first = VISIBLE[data]
    last = first & (data < 0x80)
    tail = (data & 0xC0) == 0x80
    for back, lead in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        head = first[:-back] & (data[:-back] >= lead) & (data[:-back] < (0xE0, 0xF0, 0xF8)[back - 1])
        last[back:] |= head & tail[back:]
    out[1:-1] = (data[1:-1] == 0x20) & last[:-2] & first[2:]
    return out


class ChunkEncoder:
    """Encodes texts by the vocabulary file at ``path`` and remembers chunks."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte = byte_of_symbol()
        self.special = [t["content"].encode() for t in model["added_tokens"]]
        self.bytes_of = [b""] * (1 + max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]))
        for symbol, i in model["model"]["vocab"].items():
            self.bytes_of[i] = bytes(byte[c] for c in symbol) if set(symbol) <= byte.keys() else symbol.encode()
        special = {t["id"] for t in model["added_tokens"]}
        for t in model["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
        ranks = {b: i for i, b in enumerate(self.bytes_of) if i not in special}
        self.plain = tiktoken.Encoding("chunks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.kept: dict[bytes, np.ndarray] = {}
        self.older: dict[bytes, np.ndarray] = {}
        self.held = 0

    def chunk(self, raw: bytes) -> np.ndarray:
        """Ids of a chunk encoded alone."""
        ids = self.kept.get(raw)
        if ids is None:
            ids = self.older.get(raw)
            if ids is None:
                ids = self.plain.encode_to_numpy(raw.decode(), disallowed_special=())
            if self.held > KEPT_BYTES:  # what hasn't been used since the last change goes
                self.older, self.kept, self.held = self.kept, {}, 0
            self.kept[raw] = ids
            self.held += len(raw) + ids.nbytes
        return ids

    def document(self, raw: bytes, cuts: list[int], safe: np.ndarray) -> np.ndarray:
        """Ids of a document from its chunks, which end at ``cuts``; ``safe`` are the safe places, ascending."""
        if any(s in raw for s in self.special):
            return np.array(self.library.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)
        out, begin, a = [], 0, 0  # tokens so far, how far they reach, start of the chunk
        n = len(raw)
        for b in cuts:
            ids = self.chunk(raw[a:b])
            # a place counts if the characters around it lie in the chunk
            lo, hi = np.searchsorted(safe, [a + 1, b - 1])
            first = 0 if a == 0 else int(safe[lo]) if lo < hi else -1
            last = n if b == n else int(safe[hi - 1]) if lo < hi else -1
            if first >= 0 and last > first or b == n and a == 0:
                ends = np.concatenate([[0], np.cumsum(self.size[ids])]) + a
                i, j = np.searchsorted(ends, [first, last])
                if j < len(ends) and ends[i] == first and ends[j] == last:  # the chunk's tokens agree with both places
                    if first > begin:
                        out.append(self.chunk(raw[begin:first]))
                    out.append(ids[i:j])
                    begin = last
            a = b
        if begin < n:
            out.append(self.chunk(raw[begin:n]))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode(errors="replace").encode()


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encoded(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text of an Arrow column."""
    coder = encoder(path)
    for _, _, data, offsets in slices(column):
        starts_char = np.append((data & 0xC0) != 0x80, True)
        cut = (rolling_hash(data) >> np.uint32(32 - CHUNK_BITS)) == 0 if len(data) else np.zeros(0, bool)
        cuts = np.flatnonzero(cut & starts_char[1:]) + 1
        safe = np.flatnonzero(safe_places(data))
        raw = data.tobytes()
        c, s = np.searchsorted(cuts, offsets, "right"), np.searchsorted(safe, offsets)
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            inner = cuts[c[k] : c[k + 1]] - a
            ends = inner.tolist() if len(inner) and inner[-1] == b - a else [*inner.tolist(), b - a]
            yield coder.document(raw[a:b], ends, safe[s[k] : s[k + 1]] - a)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the ids (array of long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([x.astype(np.int64) for x in encoded(batch.column(1), tokenizer)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<long>")


def encoding_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode every document; return the number of ids and the digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            rows = [(len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()) for ids in encoded(batch.column(1), tokenizer)]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, SCHEMA.types[1:], strict=True))], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
