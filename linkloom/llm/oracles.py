"""SQL of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All shared shingles are counted for every two documents, so this is for small tables.
OP5 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS start, doc_id AS node FROM s UNION SELECT r.start, l.y FROM reach r JOIN both_ways l ON l.x = r.node)
SELECT s.doc_id, len(s.shingles) AS n_shingles, c.component_id FROM s JOIN (SELECT start, min(node) AS component_id FROM reach GROUP BY start) c ON c.start = s.doc_id"""

# crc32 byte by byte over a table of 256 remainders; slots are row numbers in a shard.
OP6 = """WITH remainders AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
chars AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
docs AS (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, xor(list_reduce(bytes, lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32,
 CAST(('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 7)) AS BIGINT) % 4096 AS virtual_slot FROM chars, remainders),
slots AS (SELECT range AS vslot, range % 16 AS shard, row_number() OVER (PARTITION BY range % 16 ORDER BY CAST('0x' || left(md5(range || ':16'), 7) AS BIGINT), range) AS r FROM range(4096)),
maps AS (SELECT vslot, shard, CASE WHEN r <= 4096 / 16 - ceil(4096 / 17) THEN 16 ELSE shard END AS grown_shard FROM slots)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
 row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, CAST('0x' || left(md5(concat_ws(':', doc_id, size, text_crc32)), 7) AS BIGINT) % 16, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
 CAST(grown_shard AS INTEGER) AS grown_shard, CAST(virtual_slot AS INTEGER) AS virtual_slot, CAST(sum(size) OVER (PARTITION BY virtual_slot) AS BIGINT) AS slot_bytes FROM docs JOIN maps ON vslot = virtual_slot"""
