"""Operators 11 to 13 against brute force and SQL, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from verdanta.llm import op11_conversation_trie as prefixes
from verdanta.llm import op12_suffix_repetition as rules
from verdanta.llm import op13_filter_shapley as shapley
from verdanta.llm import queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op13_filter_shapley"])
def test_queries_agree_with_sql(spark, duck, name):
    want = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, DATA).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


# op11


def plain_trie(rows):
    """By definition, from (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, tie), (role, text)))
    convs = {c: [t for _, t in sorted(ts)] for c, ts in convs.items()}
    told = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        told[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, seq in told.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        children = [s for s in below if len(s) == len(seq) + 1]
        leaves = [s for s in below if not any(len(x) == len(s) + 1 and x[: len(s)] == s for x in below)]
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1].encode()) for s in below if s)
        ends = ",".join(str(c) for c in sorted(c for c in members if told[c] == seq))
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(children), len(leaves), saved, sha(ends)))
    return sorted(out, key=str)


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS node", "'x' AS seq")
    out = prefixes.conversation_trie(df)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert out.columns == columns and {t for c, t in out.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_trie_by_definition(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(60).tolist():
        for k in range(int(rng.integers(1, 14))):
            rows.append((c - 7 if seed == 2 else c, k, ["user", "assistant", None][k % 3], ["", "a", "é", "b" * 40][int(rng.integers(0, 2 + k % 3))]))
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_odd_conversations(spark):
    """Null ids, turns, roles and texts, equal turns, repeated rows, a conversation that ends before its borrowed turns, a long one and its copies."""
    rows = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "tie"), (2, 0, None, None), (2, 0, None, None), (3, 5, "", "")]
    rows += [(c, k, "user", f"long {k}" * (k % 3)) for c in (100, 200, 300, 405) for k in range(300)]
    rows += [(c, 0, "user", "short") for c in range(500, 520)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_many_copies_takes_a_level_per_shared_turn(spark, monkeypatch):
    """Copies are one class: their 200 turns make no levels."""
    written = []
    monkeypatch.setattr(prefixes, "stored", lambda df, scratch=None, put=prefixes.stored: written.append(1) or put(df, scratch))
    seq = "array<struct<k:binary,n:bigint>>"
    convs = spark.range(50).selectExpr("id AS conv", f"CAST(transform(sequence(1, 200), k -> struct(CAST(CAST(k AS STRING) AS BINARY) AS k, 3L AS n)) AS {seq}) AS seq")
    out = prefixes.trie(convs).collect()
    assert len(out) == 201 and len(written) < 5
    assert {r["saved_tokens"] for r in out if r["depth"] == 1} == {200 * 3 * 49}
    assert {r["n_convs"] for r in out} == {50} and {r["n_leaves"] for r in out} == {1}
    ends = ",".join(str(c) for c in range(50))
    assert [r["depth"] for r in out if r["ends_sha256"] == sha(ends)] == [200]


def test_trie_of_an_empty_table(spark):
    assert trie_rows(spark, []) == []


# op12


def plain_rules(text):
    """By definition, from sorted suffixes."""
    text = text or ""
    b = text.encode()
    n = len(b)
    suffixes = sorted(range(n), key=lambda i: b[i:])
    lcp = [0] * (n + 1)
    for r in range(1, n):
        x, y = b[suffixes[r - 1] :], b[suffixes[r] :]
        while lcp[r] < min(len(x), len(y)) and x[lcp[r]] == y[lcp[r]]:
            lcp[r] += 1
    covered, repeats = set(), set()
    for r in range(n):
        if (most := max(lcp[r], lcp[r + 1])) >= rules.LEAST:
            covered |= set(range(suffixes[r], suffixes[r] + most))
        if lcp[r] >= rules.LEAST:
            lo = hi = r
            while lcp[lo - 1] >= lcp[r]:
                lo -= 1
            while lcp[hi + 1] >= lcp[r]:
                hi += 1
            if len({b[i - 1] if i else "start" for i in suffixes[lo - 1 : hi + 1]}) > 1:
                repeats.add((lo, hi, lcp[r]))
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    longest = max((x for x in lcp if x >= rules.LEAST), default=0)
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    kept = not failed and 100 * len(covered) <= rules.COVERED * n and longest <= rules.LONGEST
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_bytes": n, "n_covered": len(covered), "longest_repeat": longest, "n_repeats": len(repeats), "base_failed": failed, "kept": kept}, covered


def random_texts(seed, n):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        letters = list(["ab \n#é", "abcdefgh \n", "a", "\0a "][int(rng.integers(0, 4))])
        blocks = ["".join(rng.choice(letters, rng.integers(1, 90))) for _ in range(4)]
        yield "".join(blocks[k] for k in rng.integers(0, 4, rng.integers(1, 12)))


ODD = [None, "", "a", " \n\t", "z" * 50, "z" * 51, "q" * 50 + "r" + "q" * 50, "q" * 49 + "r" + "q" * 49, "é" * 120, "\0" * 130, "ab\0" * 40 + "ab", "word " * 60, "one two three four five " * 2 + "six seven eight nine ten"]


def test_rules_by_definition(spark):
    texts = [*ODD, *random_texts(5, 40)]
    rows = [(i, t, "x", True) for i, t in enumerate(texts)] + [(0, "again " * 30, "x", True)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, told string, kept boolean")
    out = rules.quality_rules(df)
    assert [c for c in out.columns if c in df.columns] == ["doc_id", "text", "told", "kept"]
    for r in out.collect():
        want, covered = plain_rules(r["text"])
        assert {k: r[k] for k in want} == want, r["text"]
        assert {i for s in r["repeats"] for i in range(s["start"], s["end"])} == covered
        assert all(a["end"] < b["start"] for a, b in zip(r["repeats"], r["repeats"][1:], strict=False))


def test_rules_do_not_depend_on_slices(monkeypatch):
    texts = [*ODD, *random_texts(6, 30)]
    whole = rules.judged(pa.array(texts))
    monkeypatch.setattr(rules, "ROWS", 3)
    assert rules.judged(pa.array(texts)).equals(whole) or rules.judged(pa.array(texts)).to_pylist() == whole.to_pylist()


def test_rules_of_long_texts():
    """A text of many slices' size that is one character, and one whose second half repeats the first: work stays near linear."""
    half = "".join(f"{i * 7919 % 1000003:x} " for i in range(200_000))
    one, two = rules.judged(pa.array(["a" * 1_500_000, half + half])).to_pylist()
    assert (one["n_covered"], one["longest_repeat"]) == (1_500_000, 1_499_999)
    assert (two["n_covered"], two["longest_repeat"], two["n_repeat_words"]) == (2 * len(half), len(half), 400_000)


def test_rules_on_whole_table(spark):
    """Every document of the table by definition (the shorter ones) and of an empty table."""
    out = {r["doc_id"]: r for r in queries.op12_suffix_repetition(spark, DATA).collect()}
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert set(out) == {t["doc_id"] for t in texts}
    for t in texts:
        if len(t["text"] or "") < 2500:
            want, _ = plain_rules(t["text"])
            assert {k: out[t["doc_id"]][k] for k in want if k != "n_bytes"} == {k: v for k, v in want.items() if k != "n_bytes"}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rules.quality_rules(none).count() == 0


def test_rules_keep_clean_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    both = queries.op12_suffix_repetition(spark, DATA).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in both if r["quality"] == 1]
    assert len(good) > 20 and np.mean(good) > 0.97


# op13


def plain_audit(docs, labels):
    marks = {}
    for d, q, t in labels:
        if d is not None:
            a, b = marks.get(d, (0, 0))
            marks[d] = (a or int(q == 1), b or int(t == 1))
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    parts = {}
    for d, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if text in least and (d is None or d > least[text]) else set()
        parts.setdefault(lang or "", []).append((fails, *marks.get(d, (0, 0))))
    out = []
    for part, rows in parts.items():
        total = Counter()
        for p in permutations("ABCDE"):
            for fails, _, _ in rows:
                first = next((f for f in p if f in fails), None)
                total[first] += 1
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                gone = [r for r in rows if r[0] & set(p[:k])]
                here = [r for r in rows if not r[0] & set(p[:k]) and f in r[0]]
                out.append((part, "".join(p), k + 1, len(rows) - len(gone) - len(here), len(here), sum(f in r[0] for r in gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), total[f]))
    return sorted(out)


def test_audit_by_definition(spark):
    """Nulls, empty and long texts, copies across parts, repeated rows, several labels of one document and clashing names."""
    long = " ".join(f"w{i % 401}" for i in range(50_000))
    docs = [(1, None, None), (2, "", "en"), (3, long, "en"), (4, long, "de"), (4, long, "de"), (5, "CAPS HERE AND # THERE", "en"), (5, "other text", "de"), (None, "other text", "de"), (None, "nobody else", "de"), (6, " ".join(f"x{i}" for i in range(250)), "en"), (7, "a " * 300, "en"), (8, "é" * 97 + "ABC", "fr"), (9, "é" * 96 + "ABCD", "fr"), (10, "CAPS HERE AND # THERE", "fr")]
    labels = [(1, 1, 0), (3, 1, 1), (4, 0, 1), (4, 1, None), (10, None, None), (None, 1, 1), (99, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS part", "'x' AS mask", "2 AS good")
    got = shapley.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert shapley.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    assert shapley.audit(one, labels).count() == 600


def test_shapley_is_the_exact_integral(spark):
    """Against rationals: the sum over masks of n / |mask|, and R at every corner."""
    rng = np.random.default_rng(3)
    counts = [int(x) for x in rng.integers(0, 10**12, 32)]
    row = spark.createDataFrame([(counts,)], "n array<long>").select(shapley.coefficients("n").alias("p"))
    row = row.select(shapley.corners("p").alias("r"), *[shapley.shapley_scaled("p", i).alias(f"s{i}") for i in range(5)]).first()
    for i in range(5):
        assert row[f"s{i}"] == sum(Fraction(120 * counts[m], m.bit_count()) for m in range(32) if m >> i & 1)
    assert row["r"] == [sum(counts[m] for m in range(32) if m & s) for s in range(32)]
