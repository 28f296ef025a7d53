"""The numbered operators against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdanta.llm import op01_chat_windows as chat
from verdanta.llm import op02_warc_archive as warc
from verdanta.llm import op03_product_quantization as quantized
from verdanta.llm import op04_suffix_dedup as suffixes
from verdanta.llm import op05_byte_cnn_quality as cnn
from verdanta.llm import op06_minhash_hamming as minhash
from verdanta.llm import op07_bestfit_packing as packing
from verdanta.llm import op08_url_rules as urls
from verdanta.llm import op09_order_minhash as order_minhash
from verdanta.llm import op10_chunk_reuse_bpe as bpe
from verdanta.llm import queries
from verdanta.llm.components import components
from verdanta.llm.lyndon import suffix_arrays
from verdanta.llm.shingles import row_sets

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, a null id and an extra column."""
    long = " ".join(f"word{i % 701} of{i}" for i in range(30_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (4, long, None), (5, "one", "x"), (5, "one", "x"), (6, "  \n\t", "x"), (None, "lost id here and there", "x"), (7, "é" * 80 + "z" * 300, "x"), (8, long[1000:2000] + "tail", "x"), (9, "z" * 200, "x")]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def components_of(ids, links):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of({x for e in links for x in e}, links)
    assert got == {i: c for i, c in want.items() if c != i}


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be [brief] ~0"), (1, 1, "user", chat.CLOSE + "</s>"), (1, 2, "assistant", "a " * 600), (1, 3, "user", None), (1, 4, "assistant", "x~1<y"), (2, 0, "user", ""), (None, 0, "assistant", "n"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same")]
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), 64, 16)).collect()}
    for conv in (1, 2, 3, None):
        mine = [(r, t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(mine), sha("".join(f"{r}\n{t}\n" for r, t in mine).encode()), len(loss), sha(loss.encode()))
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def plain_windows(turns, budget, history):
    """(repeated, new) turn numbers of each window."""
    size = [len(re.findall(r"\S{1,8}", t)) + 4 for _, t in turns]
    system = turns[0][0] == "system"
    room = max(budget - (size[0] if system else 0) - history, 1)
    starts = [0]
    for i in range(len(turns)):
        if i > starts[-1] and sum(size[starts[-1] : i + 1]) > room:
            starts.append(i)
    out = []
    for lo, hi in zip(starts, [*starts[1:], len(turns)], strict=True):
        back = min(i for i in range(lo + 1) if sum(size[i:lo]) <= history and i >= min(int(system), lo))
        out.append(([0] * (system and lo > 0) + list(range(back, lo)), list(range(lo, hi))))
    return out


def test_chat_windows_by_definition(spark):
    rng = np.random.default_rng(3)
    talks = {c: [("system" if c % 2 and i == 0 else ("user", "assistant")[i % 2], f"{c}:{i} " + " ".join("w" * int(n) for n in rng.integers(1, 30, rng.integers(0, 20)))) for i in range(int(rng.integers(1, 60)))] for c in range(12)}
    rows = [(c, i, r, t) for c, talk in talks.items() for i, (r, t) in enumerate(talk)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), 96, 24).collect()
    by = {(r["conv_id"], r["window"]): r for r in got}
    for c, talk in talks.items():
        want = plain_windows(talk, 96, 24)
        assert sum(r["conv_id"] == c for r in got) == len(want)
        for k, (repeated, new) in enumerate(want):
            told = "<s>" + "".join(f"[INST]{talk[i][0]}\n{talk[i][1]}[/INST]\n" for i in [*repeated, *new]) + "</s>"
            assert by[c, k]["formatted"] == told and by[c, k]["n_repeated"] == len(repeated)
            assert [told[a : a + n] for a, n in by[c, k]["loss_spans"]] == [talk[i][1] for i in new if talk[i][0] == "assistant"]


def test_one_long_conversation_costs_as_its_turns(spark):
    turns = spark.range(40_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("word and "), 30).alias("text"))
    took = []
    for n in (100, 20_000, 40_000):
        began = time.time()
        (r,) = chat.conversation_digests(chat.format_conversations(turns.limit(n))).collect()
        took.append(time.time() - began)
        assert r["n_turns"] == n and r["loss_chars"] == n // 2 * 270
    assert took[2] < 4 * took[1] + 2


def test_chat_query_on_all_conversations(spark):
    got = {r["conv_id"]: r for r in queries.op1_chat_formatting(spark, DATA).collect()}
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect()
    assert got[-7]["loss_chars"] == len(queries.CONTROL_TEXT)
    for conv in {t["conv_id"] for t in turns}:
        mine = [t for t in turns if t["conv_id"] == conv]
        assert got[conv]["turns_sha256"] == sha("".join(f"{t['role']}\n{t['text'] or ''}\n" for t in mine).encode())


def test_warc_records(spark, tmp_path):
    body = "b" * 100
    pages = spark.createDataFrame([(3, "http://a/\r\nX: y", body), (1, None, body), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", "n" * 200)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_archive(spark, warc.write_archive(pages, str(tmp_path / "a"))).collect()}
    assert (got[3]["record_type"], got[3]["refers_to"], got[1]["record_type"]) == ("revisit", 1, "response")
    assert got[4]["record_type"] == "response" and bytes(got[5]["payload"]) == b"" and got[None]["record_type"] == "response"
    head, _, rest = bytes(got[1]["record"]).partition(b"\r\n\r\n")
    assert rest == body.encode() + b"\r\n\r\n" and f"Content-Length: {len(body)}".encode() in head
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0), str(tmp_path / "b"))).count() == 0


def test_quantisation_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(0, 0.12, (20, 16)), base[:5], rng.normal(0, 1, (900, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 3), (None, x[0].tolist())]
    got = {r["vec_id"]: r for r in quantized.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found == links.sum() > 0
    want = components_of(range(len(x)), list(zip(*map(list, np.nonzero(links)), strict=True)))
    assert all(got[i]["component_id"] == want[i] for i in want)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (2000, 2001, 2002, 2003, None))
    assert quantized.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("block", [1 << 14, 20])
def test_quantisation_finds_all_links_of_every_length(spark, monkeypatch, block):
    """64 dimensions with few, some and all directions, so that neighbours also lie straight across the lists' borders, and two rarer lengths."""
    monkeypatch.setattr(quantized, "BLOCK", block)
    rng = np.random.default_rng(5)
    flat = rng.normal(0, 1, (3000, 3)) @ rng.normal(0, 1, (3, 64)) + rng.normal(0, 0.01, (3000, 64))
    near = lambda z: np.concatenate([z, z + rng.normal(0, 0.25, z.shape)])
    ranks = [near(rng.normal(0, 1, (350, r))) @ rng.normal(0, 1, (r, 64)) for r in (8, 16)]
    spread = rng.normal(0, 1, (600, 64))
    copies = spread[:300] + rng.normal(0, 0.3, (300, 64))
    parts = [np.concatenate([flat, *ranks, spread, copies, flat[:5]]), rng.normal(0, 1, (200, 3)), rng.normal(0, 1, (40, 2))]
    rows, want, at = [], {}, 0
    for x in (p.astype(np.float32) for p in parts):
        rows += [(at + i, v.tolist()) for i, v in enumerate(x)]
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        links = (u @ u.T >= quantized.COSINE) & ~np.eye(len(x), dtype=bool)
        want |= {at + i: int(n) for i, n in enumerate(links.sum(1))}
        at += len(x)
    got = {r["vec_id"]: r["n_links"] for r in quantized.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert min(sum(want[i] for i in span) for span in (range(3000), range(3700, 4400), range(4400, 5000), range(5305, 5505), range(5505, 5545))) > 0
    assert got == want


def test_quantisation_of_many_lists_and_lengths(spark, monkeypatch):
    """Two-level means, a sample too small for the lists, repeated ids, and twenty lengths in the jobs of one."""
    monkeypatch.setattr(quantized, "ONE_LEVEL", 8)
    monkeypatch.setattr(quantized, "SAMPLE_BYTES", 40_000)
    monkeypatch.setattr(quantized, "PLANE", 1 << 9)
    rng = np.random.default_rng(8)
    rows, want, at = [], {}, 0
    for dim in [*range(1, 20), 64]:
        x = rng.normal(0, 1, (6 if dim < 64 else 900, dim))
        x = np.concatenate([x, x[: len(x) // 2] + rng.normal(0, 0.15, (len(x) // 2, dim))]).astype(np.float32)
        u = quantized.unit(x)
        links = (np.einsum("id,jd->ij", u, u) >= quantized.COSINE) & ~np.eye(len(x), dtype=bool)
        rows += [(at + i, v.tolist()) for i, v in enumerate(x)]
        want |= {at + i: int(n) for i, n in enumerate(links.sum(1))}
        at += len(x)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many lengths", "")
    got = {r["vec_id"]: r["n_links"] for r in quantized.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == want and len(jobs.getJobIdsForGroup("many lengths")) < 150
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    means = quantized.k_means(rng.normal(0, 1, (500, 5)), 60)
    assert 40 <= len(means) <= 80 and np.isfinite(means).all()
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in quantized.near_duplicates(twice).collect()) == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True)]


def test_links_at_the_limit_count_on_both_sides(spark):
    """Cosines of 19/20, as doubles give them, and equal vectors of other lengths."""
    rows = [(i + 1, [float(x) for x in v]) for i, v in enumerate([(1, 0, 0, 0, 0), (19, 5, 3, 2, 1), (19, -5, -3, -2, -1), (2, 0, 0, 0, 0), (1, 0, 0, 0, 0), (0, 0, 0, 0, 1)])]
    got = {r["vec_id"]: r for r in quantized.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in rows])
    u = quantized.unit(x)
    links = (np.einsum("id,jd->ij", u, u) >= 0.95) & ~np.eye(len(rows), dtype=bool)
    assert [got[i + 1]["n_links"] for i in range(6)] == links.sum(1).tolist() and got[1]["n_links"] >= 2 and got[6]["kept"]


def test_warc_of_repeated_pages(spark):
    rows = [(3, "http://a/", "x" * 200), (3, "http://a/", "x" * 200), (5, "http://b/", "x" * 200), (6, None, None), (None, "http://c/", "x" * 200)]
    got = warc.read_archive(spark, warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    told = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], len(r["payload"])) for r in got)
    assert told == [(0, "revisit", 3, 200), (3, "response", None, 200), (3, "response", None, 200), (5, "revisit", 3, 200), (6, "response", None, 0)]


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    strings = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 40)).tolist() for _ in range(400)]
    symbols = np.array([s for t in strings for s in [*(x + 1 for x in t), 0]], np.int16)
    bounds = np.cumsum([0, *(len(t) + 1 for t in strings)]).astype(np.int32)
    order = suffix_arrays(symbols, bounds)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        t = symbols[a:b].tolist()
        assert (order[a:b] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def brute_repeats(rows):
    first, out = {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], doc)
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < doc:
                gone[s : s + 50] = True
        out.append((doc, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum()), sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return sorted(out)


@pytest.mark.parametrize("hot", [2, suffixes.HOT])
def test_repeats_against_brute_force(spark, documents, hot):
    docs = spark.createDataFrame(documents)
    got = sorted(tuple(r) for r in suffixes.kept_digests(suffixes.lost_spans(docs, hot)).collect())
    assert got == brute_repeats(list(documents.itertuples(index=False, name=None)))


@pytest.mark.parametrize(("pieces", "levels", "least"), [(2, 1, 2), (1, 0, 10**9), (3, 4, 3)])
def test_repeats_with_crowded_and_common_keys(spark, documents, monkeypatch, pieces, levels, least):
    for name, value in (("PIECES", pieces), ("LEVELS", levels), ("SAMPLED", 1), ("LEAST", least), ("HELD_BYTES", 1 << 12), ("BATCH_SYMBOLS", 1 << 12)):
        monkeypatch.setattr(suffixes, name, value)
    got = sorted(tuple(r) for r in suffixes.kept_digests(suffixes.lost_spans(spark.createDataFrame(documents[:150]))).collect())
    assert got == brute_repeats(list(documents[:150].itertuples(index=False, name=None)))


def test_repeats_in_odd_documents(spark):
    docs = odd_documents(spark)
    got = [tuple(r) for r in suffixes.kept_digests(suffixes.lost_spans(docs)).collect()]
    want = brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    assert sorted(r for r in got if r[0] is not None) == want
    assert [r[2] for r in got if r[0] is None] == [0]
    left = {r["doc_id"]: r for r in suffixes.without_repeats(docs).collect()}
    assert left[4]["text"] == "" and left[1]["text"] is None and left[3]["lang"] == "x"
    assert suffixes.lost_spans(empty(spark)).count() == 0


def test_quality_on_held_out_rows(spark):
    got = queries.op5_byte_cnn_quality(spark, "/root/testdata/sf0.01").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    m = got.merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    m = m[m["held_out"]]
    assert (m["predicted"] == m["quality"]).mean() > 0.93


def plain_score(text, model):
    """The network on one document by definition: every place, every chunk, every filter in a loop."""
    data = list(text) or [0]
    padded = data + [0] * (model.taps - 1)
    if not text:
        padded = [0] * model.taps
    at = [np.concatenate([model.embed[b] for b in padded[i : i + model.taps]]) @ model.filters + model.bias for i in range(len(data))]
    halves = [np.maximum(np.max(at[i : i + cnn.HALF], axis=0), 0) for i in range(0, len(at), cnn.HALF)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:], strict=False)] or halves
    z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ model.out + model.offset
    return 1 / (1 + np.exp(-z))


def test_scores_by_definition():
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 5, 255, 256, 257, 511, 512, 513, 1500, 70_000)]
    model = cnn.fit([t for t in texts for _ in (0, 1)], [0, 1] * len(texts), least_steps=5, passes=1)
    offsets = np.cumsum([0, *map(len, texts)])
    got = cnn.score_documents(np.frombuffer(b"".join(texts), np.uint8), offsets, model)
    assert got == pytest.approx([plain_score(t, model) for t in texts], abs=1e-5)


def test_the_sample_is_bounded_in_bytes(spark):
    """Long labelled texts are collected as far as they fit, whole; learning from them stays small, block by block."""
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat(concat('text ', id, ' '), cast(if(id % 4 = 3, 400000, 40) / 8 AS int)) AS text")
    labels = spark.range(40).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    rows = cnn.sampled(docs, labels, class_bytes=1_000_000)
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    usable = {i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2}
    assert all(t == texts[i] and q == i % 2 and i in usable for i, t, q in rows)
    for q in (0, 1):
        assert sum(len(t) for _, t, k in rows if k == q) <= 1_000_000
    # the class of short texts is whole, of the other one as many long ones as fit
    assert {i for i, _, q in rows if q == 0} == {i for i in usable if i % 2 == 0}
    long = len(texts[3])
    assert sum(len(t) >= 300_000 for _, t, _ in rows) == min(1_000_000 // long, sum(i % 4 == 3 for i in usable))
    assert len(cnn.sampled(docs, labels, per_class=3)) == 6


def test_a_step_sees_whole_texts():
    """The strongest responses are those over the whole text, wherever they are."""
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)
    model = cnn.fit([b"a" * 600, b"b" * 700], [0, 1], least_steps=1, passes=1)
    padded, at, ends, _ = cnn.laid_out(data, np.array([150_000, 50_000]), model.taps - 1)
    x = cnn.unfolded(padded, model)
    where, top = cnn.strongest(x, at, ends, model.filters)
    whole = x @ model.filters
    assert np.allclose(top, np.maximum.reduceat(whole, np.stack([at, ends], 1).ravel()[:-1], axis=0)[::2], atol=1e-4)
    assert ((where >= at[:, None]) & (where < ends[:, None])).all()


def test_quality_of_odd_documents(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(1, 1), (2, None), (99, 0)], "doc_id long, quality int")
    got = cnn.classify(docs, cnn.train(docs, labels)).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert cnn.classify(empty(spark), cnn.train(empty(spark), labels.limit(0))).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_near(rows):
    sets = {}
    for doc, text in rows:
        sets[doc] = shingles(text)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, components_of(ids, links)


def test_near_duplicates_against_brute_force(spark, documents):
    sets, want = brute_near(documents.itertuples(index=False, name=None))
    got = minhash.near_duplicates(spark.createDataFrame(documents)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


def test_near_duplicates_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = minhash.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9} and len(got) == 10
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_shingles_of_short_slices():
    words = ["a", "b", "c", "d", "e", "f"]
    for n in range(7):
        text = " ".join(words[:n])
        (alone,) = row_sets(pa.array([text]))
        (beside, _) = row_sets(pa.array([text, "g h i j k l m n"]))
        assert len(alone) == len(shingles(text)) and alone.tolist() == beside.tolist()
    long = " ".join(f"word{i}" for i in range(150_000))
    assert len(long) > 1 << 20
    assert [len(s) for s in row_sets(pa.array([long, "a b", long]))] == [149_996, 1, 149_996]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_near_duplicates_of_one_short_row(spark, n):
    docs = spark.createDataFrame([(7, " ".join("abcd"[:n]))], "doc_id long, text string")
    assert [tuple(r) for r in minhash.near_duplicates(docs).collect()] == [(7, 1, 7, True)]


def test_near_duplicates_whose_nearest_partners_are_others(spark, monkeypatch):
    """The documents 2 and 5 are near copies, but each one's nearest partner in their only common buckets is another."""
    slots, each = minhash.SLOTS, minhash.SLOTS // minhash.CHUNKS
    place = np.arange(slots)
    other, same = (place >= each) & (place % each < 2), (place >= each) & (place < 11 * each) & (place % each >= 2)
    two = np.arange(slots)
    five = np.where(other, 1000 + place, two)
    sigs = {1: np.where(place < each, two, 2000 + place), 2: two, 3: np.where(same, 3000 + place, two), 4: np.where(same, 4000 + place, five), 5: five}
    far = lambda a, b: int((sigs[a] != sigs[b]).sum())
    assert (far(2, 3), far(4, 5), far(2, 5)) == (20, 20, minhash.MAX_ERRORS) and min(far(1, 2), far(3, 4), far(3, 5), far(2, 4)) > minhash.MAX_ERRORS
    copy = " ".join(f"w{i}" for i in range(100))
    texts = {i: " ".join(f"{i}x{j}" for j in range(100)) for i in (1, 3, 4)} | {2: copy, 5: copy + " end"}
    features = spark.createDataFrame([(i, 96, bytearray([i]), bytearray(s.astype(np.uint16).tobytes())) for i, s in sigs.items()], minhash.FEATURES)
    monkeypatch.setattr(minhash, "document_features", lambda docs: features)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for limit in (4096, 1):
        monkeypatch.setattr(minhash, "DOCUMENTS", limit)
        monkeypatch.setattr(minhash, "SHINGLES", limit)
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2}


def families(rng):
    """A family at similarities of 0.6 to 0.74, one large group of near copies with stragglers, and chains of copies of copies."""
    word = lambda: f"w{rng.integers(1 << 40)}"
    words = lambda n: [word() for _ in range(n)]

    def edited(text, n):
        text = list(text)
        for i in rng.choice(len(text), n, replace=False):
            text[i] = word()
        return text

    core, hot, chain = words(400), words(120), words(90)
    docs = [core + words(int(rng.integers(70, 130))) for _ in range(40)]
    docs += [edited(hot, int(rng.integers(1, 5))) for _ in range(120)]
    for _ in range(40):
        chain = edited(chain, 2)
        docs.append(chain)
    ids = rng.permutation(len(docs))
    return [(int(i), " ".join(d)) for i, d in zip(ids, docs, strict=True)]


@pytest.mark.parametrize(("documents_limit", "shingles_limit"), [(4096, 1 << 20), (7, 1500)])
def test_near_duplicates_in_families(spark, monkeypatch, documents_limit, shingles_limit):
    rows = families(np.random.default_rng(6))
    monkeypatch.setattr(minhash, "DOCUMENTS", documents_limit)
    monkeypatch.setattr(minhash, "SHINGLES", shingles_limit)
    emitted = []
    plain = minhash._linked

    def counted(*args):
        out = plain(*args)
        emitted.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_linked", counted)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    _, want = brute_near(rows)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    assert len(set(want.values())) < 120
    if documents_limit > len(rows):
        assert 0 < emitted[0] < len(rows)


def test_near_duplicates_in_a_large_family(spark, monkeypatch):
    """2000 texts at 0.6 to 0.74, ten of which have a near copy: rows go with documents, not with their pairs."""
    rng, n = np.random.default_rng(16), 2000
    core = [f"c{i}" for i in range(400)]
    texts = [[*core, *(f"d{i}w{k}" for k in range(int(rng.integers(80, 130))))] for i in range(n)]
    copies = {n + k: int(i) for k, i in enumerate(rng.choice(n, 10, replace=False))}
    texts += [[*texts[i][:-1], "other"] for i in copies.values()]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    # the first 396 shingles are all that two of the family share
    private = sorted(len(t) - 400 for t in texts[:n])
    alike = [100 * 396 / (396 + a + b) for a, b in (private[:2], private[-2:])]
    assert alike[0] < 75 and alike[1] > 60
    told = {}
    for name in ("_involved", "_linked"):

        def counted(*args, name=name, plain=getattr(minhash, name)):
            out = plain(*args).persist()
            told[name] = out.count()
            return out

        monkeypatch.setattr(minhash, name, counted)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: copies.get(i, i) for i in range(len(rows))}
    assert n < told["_involved"] <= len(minhash.MASKS) * len(rows) and told["_linked"] <= len(copies)


def checked_packing(rows, ids_of):
    by_seq = {}
    for r in rows:
        ids = ids_of[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(by_seq)


def plain_packing(lengths, capacity):
    """The free room of each sequence by large-item matching and best fit, one piece after the other."""
    large = sorted(x for x in lengths if 3 * x > capacity)
    rooms = []
    while large:
        a = large.pop()
        fitting = [x for x in large if x <= capacity - a]
        if fitting:
            large.remove(fitting[-1])
        rooms.append(capacity - a - (fitting[-1] if fitting else 0))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        holding = [r for r in rooms if r >= x]
        room = min(holding) if holding else capacity
        if holding:
            rooms.remove(room)
        rooms.append(room - x)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_packing_plan_by_definition(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 60))
    lengths = (rng.integers(1, capacity + 1, rng.integers(1, 400)) if seed % 3 else np.minimum(rng.geometric(4 / capacity, 300), capacity)).tolist()
    counts = {x: lengths.count(x) for x in set(lengths)}
    used = {}
    runs = sorted(packing.plan_runs(counts, capacity))
    for i, (length, rank, first, offset) in enumerate(runs):
        end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
        for k in range(end - rank):
            used.setdefault(first + k, []).append((offset, length))
    for parts in used.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts))
    assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == plain_packing(lengths, capacity)


def test_packing_is_gapless_and_tight(spark, documents):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rows = packing.pack(spark.createDataFrame(documents), path).collect()
    ids_of = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in documents.itertuples(index=False, name=None)}
    n = checked_packing(rows, ids_of)
    assert sum(r["length"] for r in rows) == sum(map(len, ids_of.values()))
    assert n <= 1.05 * -(-sum(map(len, ids_of.values())) // packing.CAPACITY) + 1
    small = packing.ranked(packing.cut_documents(spark.createDataFrame(documents), path, 64), {64: 4000} | {n: 40 for n in range(1, 64)}, 16)
    by_length = {}
    for r in small.collect():
        by_length.setdefault(r["length"], []).append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in by_length.values()) and len(by_length[64]) > 100
    odd = packing.pack(odd_documents(spark), path).collect()
    assert sum(r["start"] == 0 for r in odd) == 11 and len({(r["sequence_id"], r["offset"]) for r in odd}) == len(odd)
    assert packing.pack(empty(spark), path).count() == 0


def test_url_rules(spark):
    rows = [(1, "http://A.Example.com/en/7x?q"), (2, "https://example.com/en/8"), (3, "no scheme"), (4, None), (5, "x://sub.example.net/de/8#f"), (6, "x://net/de/"), (7, "x://notcom/en/"), (7, "x://notcom/en/")]
    got = {r["page_id"]: (r["rule"], r["verdict"], r["more"]) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("more", F.lit(1)), queries.URL_RULES).collect()}
    assert got == {1: ("example.com/en/7", "allow", 1), 2: ("com/en/", "block", 1), 3: (None, "allow", 1), 4: (None, "allow", 1), 5: ("example.net/de/8", "block", 1), 6: ("net/de/", "allow", 1), 7: (None, "allow", 1)}
    with pytest.raises(ValueError):
        urls.build_trie([("maybe", "a", "/")])


def test_order_minhash(spark, documents):
    got = order_minhash.fingerprints(spark.createDataFrame(documents)).toPandas().sort_values("doc_id")
    texts = [t or "" for t in documents["text"]]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    assert got["edited_sha256"].tolist() == [sha(t.encode()) for t in edited] and got["n_chars"].tolist() == [len(t) for t in texts]
    joined = got.merge(documents, on="doc_id")
    assert joined.groupby("text")["fingerprint"].nunique().max() == 1
    assert got["near_edited"].mean() > 5 * got["near_next"].mean() + 0.05


def plain_fingerprint(text):
    """By definition: every element has its own rank, every sketch its own order of all elements."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    bits = lambda x: x & (1 << 64) - 1
    mixed = lambda x, seed: signed(xxhash.xxh64(x, seed=bits(seed)).intdigest())
    long = lambda x, seed: mixed(bits(x).to_bytes(8, "little"), seed)
    symbols = [mixed(m.encode(), 42) for m in re.findall(r"\S{1,8}", text)]
    seen, elements = {}, []
    for place in range(len(symbols)):
        code = 42
        for s in symbols[place : place + 3]:
            code = long(s, code)
        kmer = code >> 31 << 31
        nth = seen[kmer] = seen.get(kmer, -1) + 1
        rank = mixed(nth.to_bytes(4, "little"), long(kmer, 42)) >> 31 << 31 | 1 << 31
        elements.append((rank, place))
    out = []
    for j in range(64):
        two = sorted(sorted(elements, key=lambda e: (((e[0] >> 58) + 32 - j) % 64, e))[:2], key=lambda e: e[1])
        code = 42
        for rank, _ in two:
            code = long(rank, code)
        out.append((code >> 32 or 1) & 0xFFFFFFFF if two else 0)
    return "".join(f"{c:08x}" for c in out)


def test_order_minhash_by_definition(spark, documents):
    rng = np.random.default_rng(9)
    x = [f"w{i}" for i in range(400)]
    y = [w for block in rng.permutation(40) for w in x[10 * block : 10 * block + 10]]
    short = [f"s{i}" for i in range(30)]
    texts = [" ".join(t) for t in (x, y, x + x, y + y, short, short[20:] + short[:20], ["a"] * 50, ["a"], ["a", "b"])]
    texts += [t for t in documents["text"][:60] if t]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows.select("doc_id", order_minhash.as_text(order_minhash.fingerprint(F.col("text"))).alias("f")).collect()}
    assert [got[i]["f"] for i in range(len(texts))] == [plain_fingerprint(t) for t in texts]
    alike = lambda i, j: np.mean([got[i]["f"][8 * k : 8 * k + 8] == got[j]["f"][8 * k : 8 * k + 8] for k in range(64)])
    # in a doubled text half of the pairs are of different occurrences, whose order the blocks do not change
    assert alike(0, 1) < 0.4 and alike(2, 3) < 0.6 and alike(4, 5) < 0.8


def test_order_minhash_of_odd_documents(spark):
    got = order_minhash.fingerprints(odd_documents(spark)).collect()
    assert len(got) == 11 and all(0 <= r["near_edited"] <= 1 for r in got)
    assert [r["near_edited"] for r in got if r["doc_id"] in (1, 2)] == [1.0, 1.0]
    assert order_minhash.fingerprints(empty(spark)).count() == 0
    swapped = spark.createDataFrame([(1, "a1 b2 c3 d4 e5"), (2, "d4 e5 a1 b2 c3")], "doc_id long, text string")
    assert order_minhash.fingerprints(swapped).collect()[0]["near_next"] < 1


def test_bpe_agrees_with_the_library(spark, documents):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rows = [*documents.itertuples(index=False, name=None), *((-100 - k, r["text"]) for k, r in enumerate(odd_documents(spark).collect())), (-1, "a <|endoftext|> b"), (-2, "日本 語\u00a0x  y 🙂 's")]
    got = {r["doc_id"]: r for r in bpe.encoding_digests(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert got[doc]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False).encode())


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    scored = corpus_pipeline.cnn.classify(docs, corpus_pipeline.cnn.train(docs, queries.table(spark, DATA, "labels")))
    good = {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    stages = dict(corpus_pipeline.STAGES)
    first = stages["byte_cnn_quality"](spark, docs, DATA).persist()
    assert {r["doc_id"] for r in first.collect()} == good and first.columns == columns
    _, want = brute_near([(r["doc_id"], r["text"]) for r in first.collect()])
    second = stages["minhash_hamming"](spark, first, DATA).persist()
    assert {r["doc_id"] for r in second.collect()} == {i for i, c in want.items() if i == c} and second.columns == columns
    third = stages["suffix_dedup"](spark, second, DATA).persist()
    sizes = {r[0]: r[1] - r[2] for r in brute_repeats([(r["doc_id"], r["text"]) for r in second.collect()])}
    assert third.columns == columns and all(sizes[r["doc_id"]] - 8 * 50 <= len(r["text"].encode()) <= sizes[r["doc_id"]] for r in third.collect())
    assert {r["doc_id"] for r in stages["bestfit_packing"](spark, third, DATA).collect()} == {r["doc_id"] for r in third.collect()}


CLASHES = ["lost", "score", "host", "path", "rule", "verdict", "label", "key", "doc", "row", "n", "a", "b", "w", "component", "list", "block", "salt", "window", "turns", "edited", "codes", "text hash", "hash", "found", "tag", "predicted", "held_out", "quality", "head", "rank", "length", "kept", "gone", "payload", "size", "rep", "copies", "vec", "e", "start", "given", "__doc", "__text", "__host", "nr", "end"]


def crowded(df):
    """With an extra column of every name that the operators use."""
    return df.withColumns({c: F.lit("extra") for c in CLASHES if c not in df.columns})


def same_rows(left, right):
    return sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, map(tuple, right.select(*left.columns).collect())))


def test_extra_columns_of_any_name(spark, documents):
    import corpus_pipeline

    docs = spark.createDataFrame(documents[:40]).withColumn("lang", F.lit("x"))
    path, plain = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")
    pages = spark.createDataFrame([(1, "http://a.com/en/", "<p>"), (2, None, None)], "page_id long, url string, html string")
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes")], "conv_id long, turn int, role string, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([(int(d), int(d) % 2) for d in documents["doc_id"][:40]], "doc_id long, quality int")
    model = cnn.train(docs, labels)
    for run, table in (
        (lambda t: chat.conversation_digests(chat.format_conversations(t)), turns),
        (lambda t: warc.read_archive(spark, warc.write_archive(t)).drop("record"), pages),
        (quantized.near_duplicates, vectors),
        (lambda t: suffixes.kept_digests(suffixes.lost_spans(t)), docs),
        (suffixes.without_repeats, docs),
        (lambda t: cnn.classify(t, model), docs),
        (minhash.near_duplicates, docs),
        (lambda t: packing.pack(t, path).drop("sequence_id", "offset"), docs),
        (lambda t: urls.judge_urls(t, queries.URL_RULES), pages),
        (order_minhash.fingerprints, docs),
        (lambda t: bpe.encoding_digests(t, plain), docs),
    ):
        assert same_rows(run(table), run(crowded(table)))
    extra = crowded(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, DATA)
        assert out.columns == extra.columns and out.where("score <> 'extra'").count() == 0


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline

    now = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        assert now.count() == 0


def test_no_sql_oracle_is_missing_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
