"""Registered queries of this subpackage, with their DuckDB statements where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    align, decontam, embed, html_extract, langid, license_scan, linededup, packing, prefix_trie, sharding, simhash, substring,
    urlfilter,
)
from tessera.sources.tables import load

# ---- fixed values: the URL rules (verdict, host, path prefix) ----
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# ------------------------------------------------------------------


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(load(spark, sf_dir, "pages"), carry=("url",))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(load(spark, sf_dir, "pages"), URL_RULES)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.parse(load(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed",
                        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")),
                       F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return license_scan.scan(docs.select("doc_id", path.alias("path"), "text"), id_col="doc_id")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(load(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    index = linededup.build(docs, min_docs=5, min_chars=40)
    out = linededup.drop_repeated(index, docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), capacity=1024, vocabulary="byte_bpe_50k", end_id=0)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents"), [1.0] * 16, added=[1.0])


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(load(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    rebuilt = prefix_trie.with_heads(lists, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, most=3)
    return prefix_trie.trie(rebuilt)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(load(spark, sf_dir, "documents"))


OP4_SQL = """
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
j AS (
  SELECT u.*, (SELECT arg_max(r.h || r.p, length(r.h || r.p)) FROM r
               WHERE (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)) AS rule
  FROM u)
SELECT page_id, host, path, rule,
       coalesce((SELECT r.verdict FROM r WHERE r.h || r.p = j.rule), 'allow') AS verdict
FROM j
"""

OP5_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
           FROM documents),
w AS (SELECT doc_id, CAST(i AS BIGINT) AS i, array_to_string(words[i + 1 : i + 20], ' ') AS s
      FROM (SELECT doc_id, words, unnest(range(len(words) - 19)) AS i FROM d WHERE len(words) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS later FROM w),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
c AS (SELECT p.doc_id, p.pos, p.word, max(CASE WHEN f.later THEN 1 ELSE 0 END)
             OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone
      FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.i = p.pos),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
      FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v),
e AS (SELECT a.vec_id AS u, b.vec_id AS w FROM n a JOIN n b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
r(u, w) AS (SELECT u, w FROM e UNION SELECT r.u, e.w FROM r JOIN e ON r.w = e.u),
l AS (SELECT u, count(*) AS n FROM e GROUP BY u),
m AS (SELECT u, min(w) AS w FROM r GROUP BY u)
SELECT t.vec_id, coalesce(l.n, 0) AS n_links, least(t.vec_id, coalesce(m.w, t.vec_id)) AS component_id,
       t.vec_id <= coalesce(m.w, t.vec_id) AS kept
FROM embeddings t LEFT JOIN l ON l.u = t.vec_id LEFT JOIN m ON m.u = t.vec_id
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND c.last <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

# CRC-32 in SQL: a table of 256 remainders, then a fold over the bytes
_CRC_TABLE = """
crc_steps AS (SELECT range AS i, list_reduce(list_concat([range], range(8)), lambda x, b:
                CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps)"""


def _crc32(text: str) -> str:
    """CRC-32 of a non-null string, with ``t`` (the table) in scope."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return (f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), "
            f"lambda x, b: xor(x >> 8, t[CAST(xor(x, b) & 255 AS INTEGER) + 1])), 4294967295)")


OP11_SQL = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS key,
             row_number() OVER () AS r FROM documents),
s AS (SELECT r, shard, 1 / -ln((CAST('0x' || substr(md5(key || '/' || shard), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS score
      FROM d, range(17) n(shard)),
b AS (SELECT r, arg_max(shard, score) FILTER (shard < 16) AS shard, arg_max(shard, score) AS grown FROM s GROUP BY r),
a AS (SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, {_crc32("text")} AS text_crc32, shard, grown
      FROM d JOIN b USING (r), crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM a
"""

OP12_SQL = f"""
WITH {_CRC_TABLE},
o AS (SELECT conv_id, md5(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS w, turn
      FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(struct_pack(dg := dg, w := w) ORDER BY turn NULLS FIRST, dg, w) AS own FROM o GROUP BY conv_id),
h AS (SELECT conv_id, own, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM l, crc_table),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1 : len(h.own)]) AS seq
      FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, len(seq) = d AS ends, md5(list_aggregate(list_concat([''], list_transform(seq[1:d], lambda x: x.dg)), 'string_agg', '')) AS node,
             CASE WHEN d > 0 THEN md5(list_aggregate(list_concat([''], list_transform(seq[1:d - 1], lambda x: x.dg)), 'string_agg', '')) END AS up,
             CASE WHEN d > 0 THEN seq[d].w ELSE 0 END AS w
      FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
n AS (SELECT d, node, up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM p GROUP BY d, node, up),
k AS (SELECT up AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, d)),
t AS (SELECT a.node, a.d, CAST(sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(m.own) AS BIGINT) AS saved_tokens
      FROM (SELECT DISTINCT a.node, a.d, b.node AS below, b.d AS below_d FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.d <= b.d) a
      JOIN m ON m.node = a.below AND m.d = a.below_d GROUP BY a.node, a.d)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children,
       t.n_leaves, t.saved_tokens, m.ends_sha256
FROM m JOIN t ON t.node = m.node AND t.d = m.d LEFT JOIN n u ON u.node = m.up AND u.d = m.d - 1
"""

LLM_QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_sharding": op11_sharding,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_alignment": op13_token_alignment,
}

LLM_SQL = {
    "op4_url_filter": OP4_SQL.strip(),
    "op5_substring_dedup": OP5_SQL.strip(),
    "op8_embedding_near_dedup": OP8_SQL.strip(),
    "op9_line_dedup": OP9_SQL.strip(),
    "op11_sharding": OP11_SQL.strip(),
    "op12_prefix_trie": OP12_SQL.strip(),
}
