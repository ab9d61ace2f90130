"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.llm import alignment, licenses, mixing, neardup, packing, prefixtrie, quality, search, secrets, substrings, toxicity, warc, wordpieces
from tabulens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers that are installed beside the session; on a cluster, on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _op1(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.scheduled(table(spark, folder, "documents"))


def _op2(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = wordpieces.sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    return wordpieces.token_counts(table(spark, folder, "documents"), vocabulary)


def _op3(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def _op4(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def _op5(spark: SparkSession, folder: str) -> DataFrame:
    """Each document whose doc_id is divisible by 20 against all documents."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = rows.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")
    return search.top_k(rows, queries).select(F.col("query_id").alias("query_doc_id"), "rank", F.col("id").alias("doc_id"), "score")


def _op6(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def _op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def _op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _op9(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def _op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def _op11(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _op12(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefixtrie.rebuilt(prefixtrie.keyed(table(spark, folder, "conversations")))
    return prefixtrie.prefix_tree(turns).drop("node", "parent")


def _op13(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_mix": _op1,
        "op2_token_counts": _op2,
        "op3_secret_scan": _op3,
        "op4_near_duplicates": _op4,
        "op5_topk_search": _op5,
        "op6_warc": _op6,
        "op7_packing": _op7,
        "op8_toxicity": _op8,
        "op9_license_scan": _op9,
        "op10_quality": _op10,
        "op11_substring_dedup": _op11,
        "op12_prefix_trie": _op12,
        "op13_token_alignment": _op13,
    }


_OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), l AS (
  SELECT *, 3 * source_size / weight AS limit_level,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3 * source_size) OVER before, 0)::DOUBLE) / sum(weight) OVER rest AS level,
    row_number() OVER (ORDER BY 3 * source_size / weight, source ASC NULLS LAST) AS place
  FROM w
  WINDOW before AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    rest AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), t AS (
  SELECT source, source_size, least((SELECT arg_min(level, place) FROM l WHERE level <= limit_level) * weight, (3 * source_size)::DOUBLE) AS target FROM l
), o AS (
  SELECT d.row, d.doc_id, d.source, d.size, t.source_size, t.target, round(t.target)::BIGINT AS words,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS lo
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT source, (sum(blocks) OVER line - blocks)::BIGINT AS start, (sum(blocks) OVER line)::BIGINT AS stop, sum(blocks) OVER ()::BIGINT AS total
  FROM (SELECT source, ceil(round(target) / 4096)::BIGINT AS blocks FROM t WHERE round(target) > 0)
  WINDOW line AS (ORDER BY source ASC NULLS LAST)
), p AS (
  SELECT source, unnest(range(start, stop)) AS point, CASE WHEN total > 1 THEN length(bin(total - 1)) ELSE 0 END AS bits FROM b
), v AS (
  SELECT source, coalesce(list_sum(list_transform(range(bits), lambda i: ((point >> i) & 1) << (bits - 1 - i))), 0)::BIGINT AS position FROM p
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS rank FROM v
), f AS (
  SELECT row, source, turn * source_size + lo AS a, least(turn * source_size + lo + size, words) AS z
  FROM o, (VALUES (0), (1), (2)) turns(turn) WHERE size > 0 AND turn * source_size + lo < words
), m AS (
  SELECT f.row, min(r.position) AS position
  FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source AND r.rank BETWEEN f.a // 4096 AND (f.z - 1) // 4096 GROUP BY f.row
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(lo + size, words) - lo)
  + greatest(0, least(source_size + lo + size, words) - (source_size + lo))
  + greatest(0, least(2 * source_size + lo + size, words) - (2 * source_size + lo)))::BIGINT AS taken,
  m.position
FROM o LEFT JOIN m ON o.row = m.row
"""


def _op3_sql() -> str:
    spans = []
    for i, rule in enumerate(secrets.RULES):
        pattern = secrets.class_pattern(rule.pattern).replace("'", "''")
        spans.append(
            f"SELECT r, {i} AS number, '{rule.kind}' AS kind, g, w, regexp_extract_all(text, '{pattern}', {rule.group}) AS v FROM "
            f"(SELECT r, text, regexp_split_to_array(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS w FROM d)"
        )
    leasts = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(secrets.RULES))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), m AS (
  {" UNION ALL ".join(spans)}
), i AS (
  SELECT r, number, kind, g, w, v, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0
), p AS (
  SELECT r, number, kind, length(w[i]) AS n, length(v[i]) AS value,
    sum(length(g[i])) OVER (PARTITION BY r, number ORDER BY i) + sum(length(w[i])) OVER (PARTITION BY r, number ORDER BY i) - length(w[i]) AS start
  FROM i
), k AS (
  SELECT *, kind || ':' || start::BIGINT::VARCHAR || ':' || (start + n)::BIGINT::VARCHAR AS span FROM p WHERE value >= CASE number {leasts} END
), a AS (
  SELECT r, string_agg(span, ',' ORDER BY start, number) AS spans, string_agg(span, ',' ORDER BY start, number) FILTER (number < 3) AS base,
    count(*) FILTER (number = 0) AS n0, count(*) FILTER (number = 1) AS n1, count(*) FILTER (number = 2) AS n2
  FROM k GROUP BY r
)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), i AS (
  SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM i
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT a AS doc_id, b AS other FROM both_ways
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), c AS (
  SELECT doc_id, min(other) AS least_other FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least_other, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.least_other, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {5 * i + 1}, 5))::INTEGER // {32**j}) % 32, 1)"
    for i in range(8) for j in (3, 2, 1, 0)
)
_OP6 = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest FROM p
), o AS (
  SELECT payload_digest, min(page_id) AS original FROM d GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM d JOIN o USING (payload_digest)
"""


_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (
  SELECT r, doc_id, w, unnest(range(1, greatest(1, len(w) - 11))) AS i FROM d
), s AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS words FROM i
), f AS (
  SELECT words, min(doc_id) AS first FROM s GROUP BY words
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM s JOIN f USING (words) WHERE first < doc_id
), p AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), k AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM p ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


_OP12 = r"""
WITH o AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS t FROM o GROUP BY conv_id
), i AS (
  SELECT conv_id, t, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, k: xor(y >> 1, (y & 1) * 3988292384))
  )) % 4 AS h FROM t
), s AS (
  SELECT i.conv_id, list_concat(coalesce(b.t[1:h], []), i.t[h + 1:]) AS s FROM i LEFT JOIN t b ON b.conv_id = i.conv_id - i.conv_id % 20
), u AS (
  SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM s
), n AS (
  SELECT depth, s[1:depth] AS s, min(conv_id) AS conv_id, count(*) AS n_convs FROM u GROUP BY ALL
), e AS (
  SELECT s, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM s GROUP BY s
), m AS (
  SELECT n.*, coalesce(len(regexp_extract_all(s[depth].text, '[^\x20\x09-\x0D]+')), 0) AS words,
    (SELECT count(*) FROM n c WHERE c.depth = n.depth + 1 AND c.s[1:n.depth] = n.s) AS n_children
  FROM n
), a AS (
  SELECT m.depth, m.s, m.conv_id, m.n_convs, m.n_children, count(*) FILTER (d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.words) AS saved_tokens
  FROM m JOIN m d ON d.depth >= m.depth AND d.s[1:m.depth] = m.s GROUP BY ALL
)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs::BIGINT AS n_convs, a.n_children::BIGINT AS n_children,
  a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM a LEFT JOIN n p ON p.depth = a.depth - 1 AND p.s = a.s[1:a.depth - 1] LEFT JOIN e ON e.s = a.s
"""


def llm_oracles() -> dict[str, str]:
    return {"op1_mix": _OP1, "op3_secret_scan": _op3_sql(), "op4_near_duplicates": _OP4, "op6_warc": _OP6, "op11_substring_dedup": _OP11, "op12_prefix_trie": _OP12}
