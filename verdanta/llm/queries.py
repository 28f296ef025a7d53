"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_chat_windows as chat
from . import op02_warc_archive as warc
from . import op03_product_quantization as quantized
from . import op04_suffix_dedup as suffixes
from . import op05_byte_cnn_quality as cnn
from . import op06_minhash_hamming as minhash
from . import op07_bestfit_packing as packing
from . import op08_url_rules as urls
from . import op09_order_minhash as order_minhash
from . import op10_chunk_reuse_bpe as bpe
from . import op11_conversation_trie as prefixes
from . import op12_suffix_repetition as rules
from . import op13_filter_shapley as shapley

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(extra)))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archive(spark, warc.write_archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


def op3_product_quantization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.kept_digests(suffixes.lost_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = cnn.train(docs, table(spark, sf_dir, "labels"))
    return cnn.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


def op10_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat", "n_repeats")


def op13_filter_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapley.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_warc_archive": op2_warc_archive,
    "op3_product_quantization": op3_product_quantization,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_byte_cnn_quality": op5_byte_cnn_quality,
    "op6_minhash_hamming": op6_minhash_hamming,
    "op7_bestfit_packing": op7_bestfit_packing,
    "op8_url_rules": op8_url_rules,
    "op9_order_minhash": op9_order_minhash,
    "op10_chunk_reuse_bpe": op10_chunk_reuse_bpe,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_suffix_repetition": op12_suffix_repetition,
    "op13_filter_shapley": op13_filter_shapley,
}

ORACLES: dict[str, str] = {
    "op2_warc_archive": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM d JOIN f USING (payload_digest)""",
    "op8_url_rules": """
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
        r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        m AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
              FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND k = 1""",
    "op11_conversation_trie": """
        WITH RECURSIVE crc(b, v, k) AS (SELECT range, range::BIGINT, 0 FROM range(256)
            UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8),
        crcs AS (SELECT list(v ORDER BY b) AS tab FROM crc WHERE k = 8),
        t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(encode(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')))) AS nr
              FROM conversations WHERE conv_id IS NOT NULL),
        seqs AS (SELECT c, list({'r': role, 't': text} ORDER BY nr) AS seq FROM t GROUP BY c),
        hs AS (SELECT c, seq, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 9 AS h FROM seqs, crcs),
        reb AS (SELECT a.c, coalesce(b.seq[1:a.h], []) || a.seq[a.h + 1:] AS seq FROM hs a LEFT JOIN seqs b ON b.c = a.c - a.c % 5),
        pre AS (SELECT c, d, seq[1:d] AS prefix, len(seq) AS n FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM reb)),
        memb AS (SELECT c, d, n, prefix, min(c) OVER (PARTITION BY d, prefix) AS node FROM pre),
        nodes AS (SELECT node, d, count(*) AS n_convs, any_value(octet_length(encode(coalesce(prefix[d].t, '')))) AS bytes,
                         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM memb GROUP BY node, d),
        kids AS (SELECT p.node, p.d, count(*) AS n_children FROM nodes x JOIN memb p ON p.c = x.node AND p.d = x.d - 1 GROUP BY p.node, p.d),
        full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.node = n.node AND k.d = n.d),
        subs AS (SELECT m.node, m.d, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved
                 FROM full_nodes x JOIN memb m ON m.c = x.node AND m.d <= x.d GROUP BY m.node, m.d)
        SELECT f.node AS conv_id, f.d::BIGINT AS depth, p.node AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
               s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
        FROM full_nodes f JOIN subs s ON s.node = f.node AND s.d = f.d LEFT JOIN memb p ON p.c = f.node AND p.d = f.d - 1""",
    "op13_filter_shapley": """
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, len(words) < 200 AS fa, 100 * len(list_distinct(words)) < 50 * len(words) AS fb,
                     100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS fc, regexp_matches(text, '[#$%&*|]') AS fd,
                     coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), min(w.doc_id) OVER (PARTITION BY text) IS NOT NULL) AS fe
              FROM w LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id) l ON l.doc_id = w.doc_id),
        docs AS (SELECT part, good, bad, {'A': fa, 'B': fb, 'C': fc, 'D': fd, 'E': fe} AS x, fa::INT + fb::INT + fc::INT + fd::INT + fe::INT AS n_fails FROM f),
        grouped AS (SELECT part, good, bad, x, n_fails, count(*) AS n FROM docs GROUP BY ALL),
        l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM l a, l b, l c, l d, l e
                   WHERE a.c NOT IN (b.c, c.c, d.c, e.c) AND b.c NOT IN (c.c, d.c, e.c) AND c.c NOT IN (d.c, e.c) AND d.c <> e.c),
        steps AS (SELECT o, s FROM orders, range(1, 6) r(s)),
        g AS (SELECT part, good, bad, n_fails, n, CASE WHEN x.A THEN 'A' ELSE '' END || CASE WHEN x.B THEN 'B' ELSE '' END || CASE WHEN x.C THEN 'C' ELSE '' END || CASE WHEN x.D THEN 'D' ELSE '' END || CASE WHEN x.E THEN 'E' ELSE '' END AS fails FROM grouped),
        j AS (SELECT g.*, o, s, o[s] AS letter, contains(fails, o[s]) AS fails_this, len(list_filter(string_split(o[1:s - 1], ''), lambda k: k <> '' AND contains(fails, k))) > 0 AS gone FROM g, steps)
        SELECT part, o AS filter_order, s::INTEGER AS step, coalesce(sum(n) FILTER (NOT gone AND NOT fails_this), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_this), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (gone AND fails_this), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
               coalesce(sum(n) FILTER (NOT gone AND fails_this AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fails_this AND bad = 1), 0)::BIGINT AS toxic_lost,
               coalesce(sum(n * 120 // greatest(n_fails, 1)) FILTER (fails_this), 0)::BIGINT AS shapley
        FROM j GROUP BY part, o, s""",
}
