"""DuckDB SQL for the document queries that SQL can express, over the whole tables.

The others have none: SQL has no XXH64, no tokenizer, no positions of regular-expression matches, and no models; tests
hold them against plain versions, round trips or held-out labels.
"""

ORACLES = {
    "op1_repetition_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
k AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, w, len(w) AS n FROM d),
g AS (SELECT r, i, i + 2 <= n AS in3, i + 9 <= n AS in10, i + 100 <= n AS in101,
    array_to_string(w[i:i + 2], ' ') AS g3, array_to_string(w[i:i + 9], ' ') AS g10, md5(array_to_string(w[i:i + 100], ' ')) AS g101 FROM k),
f AS (SELECT r, i,
    in3 AND count(*) OVER (PARTITION BY r, in3, g3) > 1 AS h3,
    in10 AND count(*) OVER (PARTITION BY r, in10, g10) > 1 AS h10,
    in101 AND count(*) OVER (PARTITION BY r, in101, g101) > 1 AS h101 FROM g),
c AS (SELECT r, h101,
    bool_or(h3) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
    bool_or(h10) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10 FROM f),
s AS (SELECT r, count(*) FILTER (c3) AS c3, count(*) FILTER (c10) AS c10, bool_or(h101) AS long FROM c GROUP BY r),
v AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(c3, 0) AS n_repeat_words, coalesce(c10, 0) AS covered_words, coalesce(long, false) AS long
  FROM d LEFT JOIN s ON d.r = s.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * covered_words <= 20 * n_words AND NOT long AS kept, covered_words
FROM b""",
    "op3_warc_salvage": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
m AS (SELECT x, max(page_id) AS last FROM s GROUP BY x),
b AS (SELECT s.*, last, list_transform(range(8), lambda i: CAST('0x' || substr(s.x, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS v FROM s JOIN m ON s.x = m.x)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v[CAST(i // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM b""",
}


def _shard_sql(shards: int) -> str:
    return f"list_reduce(list_transform(range({shards}), lambda s: {{'score': 1.0 / -ln((CAST('0x' || substr(md5('k' || doc_id || '@' || s), 1, 13) AS BIGINT) + 0.5) / pow(16, 13)), 's': s}}), lambda a, b: CASE WHEN b.score > a.score THEN b ELSE a END).s"


#: CRC-32 by its table, byte by byte. Slots are numbered by doc_id in an input split; the tables of the SQL check are one.
ORACLES["op7_rendezvous_shards"] = rf"""
WITH RECURSIVE z(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM z WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS z FROM z WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, CAST(len(h) // 2 + 1 AS BIGINT) AS size, list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))) AS bytes FROM d),
e AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, z[CAST((xor(c, x) & 255) + 1 AS INTEGER)])), 4294967295) AS text_crc32, CAST({_shard_sql(16)} AS INTEGER) AS shard, CAST({_shard_sql(17)} AS INTEGER) AS grown_shard FROM b, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM e"""
