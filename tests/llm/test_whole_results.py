"""All columns of queries that have no SQL, and the pipeline from end to end, by definition."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from verdanta.llm import op01_chat_windows as chat
from verdanta.llm import op05_byte_cnn_quality as cnn
from verdanta.llm import op08_url_rules as urls
from verdanta.llm import op09_order_minhash as order_minhash
from verdanta.llm import op10_chunk_reuse_bpe as bpe
from verdanta.llm import queries

from test_numbered_operators import DATA, brute_near, checked_packing, documents, empty, plain_fingerprint, plain_score, sha  # noqa: F401


def test_chat_query_in_all_columns(spark):
    got = {r["conv_id"]: r for r in queries.op1_chat_formatting(spark, DATA).collect()}
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect()
    convs = {-7: [("user", queries.CONTROL_TEXT), ("assistant", queries.CONTROL_TEXT)]}
    for t in turns:
        convs.setdefault(t["conv_id"], []).append((t["role"] or "", t["text"] or ""))
    source = spark.createDataFrame([(c, k, *t) for c, ts in convs.items() for k, t in enumerate(ts)], "conv_id long, turn long, role string, text string")
    formatted = {}
    for w in chat.format_conversations(source).collect():
        formatted.setdefault(w["conv_id"], []).append(w["formatted"])
    assert set(got) == set(convs)
    for c, ts in convs.items():
        loss = "".join(text for role, text in ts if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(ts) and r["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for role, text in ts).encode())
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == sha(loss.encode())
        assert r["formatted_chars"] == sum(map(len, formatted[c]))
        assert all(f.startswith("<s>") and f.endswith("</s>") for f in formatted[c])


def test_order_minhash_in_all_columns(spark, documents):  # noqa: F811
    rows = [(int(d), t) for d, t in documents.itertuples(index=False, name=None) if len(t or "") < 2500][:40]
    texts = [t or "" for _, t in rows]
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    plain = [plain_fingerprint(t) for t in texts]
    plain_edited = [plain_fingerprint(t) for t in edited]
    alike = lambda a, b: sum(a[8 * k : 8 * k + 8] == b[8 * k : 8 * k + 8] for k in range(64)) / 64
    got = {r["doc_id"]: r for r in order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (doc, text) in enumerate(rows):
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text or ""), sha(edited[i].encode()))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain[i], plain_edited[i])
        assert r["near_edited"] == alike(plain[i], plain_edited[i]) and r["near_next"] == alike(plain[i], plain[(i + 1) % len(rows)])


def test_chunks_that_are_forgotten_are_encoded_again(monkeypatch, documents):  # noqa: F811
    """Generations of the cache change all the time; the ids stay those of the library."""
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts = [t for t in documents["text"] if t][:80] * 2
    for kept in (0, 3000):
        monkeypatch.setattr(bpe, "KEPT_BYTES", kept)
        monkeypatch.setattr(bpe, "encoder", lambda path, one=bpe.ChunkEncoder(path): one)
        for text, ids in zip(texts, bpe.encoded(pa.array(texts), path), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_empty_tables_of_urls_and_encodings(spark):
    path = queries.vocabulary("byte_bpe_50k.json")
    assert bpe.encoding_digests(empty(spark), path).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0
    long = "x://" + "a." * 50_000 + "example.com" + "/en/7" * 50_000
    got = urls.judge_urls(spark.createDataFrame([(1, long)], "page_id long, url string"), queries.URL_RULES).first()
    assert (got["rule"], got["verdict"]) == ("example.com/en/7", "allow")


def test_pipeline_from_end_to_end(spark, tmp_path):
    """Every stage by brute force over what its predecessor kept, and run() gives the last stage's rows."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    # the table's shorter documents, since the stages' brute-force forms are slow
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.char_length("text") < 1500).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    model = cnn.train(docs, labels)
    scores = {i: plain_score((r["text"] or "").encode(), model) for i, r in rows.items()}
    assert all(abs(s - cnn.THRESHOLD) > 1e-6 for s in scores.values())
    stages = dict(corpus_pipeline.STAGES)
    table = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
    now = {i: r for i, r in rows.items() if scores[i] >= cnn.THRESHOLD}
    first = stages["byte_cnn_quality"](spark, docs, str(tmp_path))
    assert table(first) == now and 0 < len(now) < len(rows)
    _, group = brute_near([(i, r["text"]) for i, r in now.items()])
    now = {i: r for i, r in now.items() if group[i] == i}
    second = stages["minhash_hamming"](spark, first, str(tmp_path))
    assert table(second) == now
    # the bytes that no earlier document has, without what is left of cut characters
    kept = {}
    seen = {}
    for i in sorted(now):
        b = (now[i]["text"] or "").encode()
        for s in range(len(b) - 49):
            seen.setdefault(b[s : s + 50], i)
    for i, r in now.items():
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if seen[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        text = np.frombuffer(b, np.uint8)[~gone].tobytes().decode(errors="ignore")
        kept[i] = r | {"text": text, "n_chars": len(text)} if gone.any() else r | {"n_chars": len(r["text"] or "")}
    third = stages["suffix_dedup"](spark, second, str(tmp_path))
    got = table(third)
    assert got == kept and any(len(kept[i]["text"]) < len(now[i]["text"]) for i in now)
    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    ids_of = {i: [*library.encode(r["text"], add_special_tokens=False).ids, 0] for i, r in kept.items()}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    checked_packing(last, ids_of)
    assert sum(r["length"] for r in last) == sum(map(len, ids_of.values())) and {r["doc_id"] for r in last} == set(kept)
    staged = stages["bestfit_packing"](spark, third, str(tmp_path)).collect()
    piece = lambda rs: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert piece(last) == piece(staged) and len({r["sequence_id"] for r in last}) == len({r["sequence_id"] for r in staged})


def test_shingle_sets_of_a_batch_leave_a_task_slice_by_slice(spark, monkeypatch):
    from verdanta.llm import op06_minhash_hamming as minhash
    from verdanta.llm import texts
    from verdanta.llm.shingles import row_sets

    rows = [(i, None if i % 7 == 0 else " ".join(f"w{i % 5}x{k}" for k in range(i))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    class Kept:
        """Stands for a DataFrame and keeps what mapInArrow is given."""

        def __getattr__(self, name):
            return (lambda run, _: run) if name == "mapInArrow" else lambda *a: self


    monkeypatch.setattr(texts.slices, "__defaults__", (200,))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows], pa.string())], names=["doc", "text"])
    out = list(minhash._shingled(Kept(), None)(iter([batch])))
    assert len(out) > 5 and max(b.column(1).nbytes for b in out) < batch.nbytes
    got = {d: f for b in out for d, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert got == {i: s.tobytes() for (i, _), s in zip(rows, row_sets(batch.column(1)), strict=True)}
    monkeypatch.undo()
    whole = {r["doc"]: bytes(r["found"]) for r in minhash._shingled(docs, docs.select(docs["doc_id"].alias("doc"))).collect()}
    assert whole == got
