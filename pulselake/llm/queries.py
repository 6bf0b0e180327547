"""Queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm import alignment, decontaminate, hyperminhash, langid, licenses, mtree, packing, simhash, suffixes, tokens, trie, unigram, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"), queries="id % 50 = 0", k=5, scale=256.0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), max_bits=2, shingle=3)
    return found.select("doc_id", "fingerprint", "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _crc(ids: str = "ids"):
    return F.crc32(ids).alias("ids_crc32")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", _crc())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "n_words")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unigram.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "score")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", F.round("coverage", 9).alias("coverage"), "first_word", "verbatim")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)
    return out.select("doc_id", "start", "length", _crc(), "doc_tokens", "sequence_id", "offset")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("digest")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokens(_table(spark, sf_dir, "documents"), a, b).drop("links")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


#: Sets of shingles, links by their common ones, and the smallest document that links reach.
OP11_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), g AS (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [hash(array_to_string(words, ' '))]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: hash(array_to_string(words[i:i + 3], ' ')))) END AS s
  FROM w
), c AS (
  SELECT min(r) AS k, list_sort(s) AS s FROM g WHERE len(s) > 0 GROUP BY list_sort(s)
), e AS (
  SELECT k, len(s) AS n, unnest(s) AS h FROM c
), l AS (
  SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.h = b.h AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.k, b.k HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), b AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reached(k, z) AS (
  SELECT k, k FROM c UNION SELECT reached.k, b.b FROM reached JOIN b ON b.a = reached.z
), t AS (
  SELECT reached.k, min(g.doc_id) AS component_id FROM reached JOIN c ON c.k = reached.z JOIN g ON list_sort(g.s) = c.s GROUP BY reached.k
)
SELECT g.doc_id, len(g.s) AS n_shingles, CASE WHEN len(g.s) = 0 THEN g.doc_id ELSE t.component_id END AS component_id,
  len(g.s) = 0 OR g.doc_id IS NOT DISTINCT FROM t.component_id AS kept
FROM g LEFT JOIN c ON c.s = list_sort(g.s) AND len(g.s) > 0 LEFT JOIN t ON t.k = c.k
"""

#: Rebuilt conversations, all their prefixes, and every prefix with all that lie below it.
OP12_SQL = """
WITH bits AS (
  SELECT list(x ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS x FROM range(256) r(i))
), o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, n, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id), bits
), i AS (
  SELECT c.conv_id, c.h, least(c.h, coalesce(b.n, 0)) AS lead FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5
), r AS (
  SELECT i.conv_id, o.place AS depth, role, text FROM i JOIN o ON o.conv_id = i.conv_id - i.conv_id % 5 WHERE o.place <= i.lead
  UNION ALL SELECT i.conv_id, o.place - i.h + i.lead, role, text FROM i JOIN o ON o.conv_id = i.conv_id WHERE o.place > i.h
), s AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS bytes, string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM i
), l AS (
  SELECT *, lag(node) OVER w AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), n AS (
  SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS sha
  FROM l GROUP BY node
), k AS (
  SELECT n.*, (SELECT count(*) FROM n m WHERE m.up = n.node) AS n_children FROM n
), a AS (
  SELECT DISTINCT t.node AS top, b.node AS below FROM s t JOIN s b ON t.conv_id = b.conv_id AND t.depth <= b.depth
), u AS (
  SELECT top, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM a JOIN k ON k.node = a.below GROUP BY top
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, CAST(k.n_children AS BIGINT) AS n_children, n_leaves, saved_tokens, k.sha AS ends_sha256
FROM k JOIN u ON u.top = k.node LEFT JOIN n p ON p.node = k.up
"""


def _op3_sql() -> str:
    """Hosts, paths and the longest rule that fits; else the patterns of the method."""
    rules = ", ".join(f"('{a}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for a, r in urls.PATH_RULES)
    topics = "|".join(urls.SPAM_TOPICS)
    # The topic begins a label before a hyphen, ends one, stands between hyphens, is one that another follows, or is a folder.
    spam = f"regexp_matches(host || path, '^([^/]*[.])?(({topics})-|({topics})[.]|.*-({topics})[.-]|.*/({topics})/)', 's')"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {rules}) AS t(action, rule, rule_host, rule_path)),
j AS (SELECT h.*, r.action, r.rule, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC) AS n
  FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN {spam} THEN 'block' ELSE 'allow' END) AS verdict FROM j WHERE n = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mtree_search, op2_simhash, op3_url_filter, op4_token_ids, op5_language_id, op6_token_counts, op7_suffix_dedup, op8_decontaminate, op9_pack, op10_license_scan, op11_hyperminhash, op12_prefix_trie, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mtree_search": OP1_SQL, "op3_url_filter": _op3_sql(), "op11_hyperminhash": OP11_SQL, "op12_prefix_trie": OP12_SQL}
