"""SQL building blocks of the catalogue's oracles."""

from __future__ import annotations

from linkloom.functions import text as T
from linkloom.plans.views import raw_sql, truth_sql

_MISSING = ", ".join(f"'{m}'" for m in T.MISSING)
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(T.ADDRESS_STOPWORDS))


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def present(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR lower(trim({x})) IN ({_MISSING}) THEN '' ELSE {x} END"


def alnum(x: str) -> str:
    return squeeze(f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\s]', ' ', 'g')")


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def grams(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) < {n} THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n}))) END"


def replaced(tokens: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"list_transform({tokens}, lambda t: CASE t {cases} ELSE t END)"


def entities(view: str) -> str:
    """CTEs up to ``ent`` (normalized entities with the address fields), ``s1``, ``tg`` and, for parts, ``gt``."""
    first = lambda p: f"nullif(regexp_extract(addr_cleaned, '{p}', 1), '')"
    house1 = "split_part(split_part(nullif(regexp_extract(addr_cleaned, '\\b(?:h\\.?no\\.?|plot\\s+no\\.?|door\\s+no\\.?|no\\.?|house\\s+no\\.?)\\s*[:#-]?\\s*([0-9]+[a-z\\-/0-9]*)', 1), ''), '/', 1), '-', 1)"
    house2 = first("^([0-9]+[a-z]?)\\b")
    house3 = "list_filter(list_transform(string_split(addr_cleaned, ','), lambda p: nullif(regexp_extract(trim(p), '^([0-9]+[a-z]?)\\s+[a-z]', 1), '')), lambda p: p IS NOT NULL AND length(p) BETWEEN 1 AND 5)[1]"
    postal = " ".join(f"WHEN '{c}' THEN regexp_extract_all(business_address, '{p.replace('(?:-', '(?:-')}', 1)[-1]" for c, p in T.POSTAL.items())
    return f"""raw AS ({raw_sql(view)}),
n1 AS (SELECT entity_id, coalesce(business_name, '') AS business_name, coalesce(business_address, '') AS business_address, coalesce(country, '') AS country FROM raw),
n2 AS (SELECT *, lower({squeeze('nfc_normalize(' + present('business_name') + ')')}) AS name_cleaned,
  {squeeze("regexp_replace(lower(" + squeeze('nfc_normalize(' + present('business_address') + ')') + "), '\\bnull\\b', ' ', 'g')")} AS addr_cleaned,
  lower({squeeze('nfc_normalize(' + present('country') + ')')}) AS country_cleaned FROM n1),
n3 AS (SELECT *, strip_accents(name_cleaned) AS name_no_accents, strip_accents(addr_cleaned) AS addr_no_accents FROM n2),
n4 AS (SELECT *, {alnum('name_no_accents')} AS name_alphanumeric, {alnum('addr_no_accents')} AS addr_alphanumeric FROM n3),
n5 AS (SELECT *, {words('name_alphanumeric')} AS name_tokens, {words('addr_alphanumeric')} AS addr_tokens FROM n4),
n6 AS (SELECT *, list_filter(addr_tokens, lambda t: regexp_matches(t, '\\p{{Nd}}')) AS addr_numeric_tokens FROM n5),
ent AS (SELECT *, list_filter(addr_tokens, lambda t: length(t) >= 3 AND t NOT IN ({_STOP})) AS addr_words,
  list_sort(list_distinct(addr_numeric_tokens)) AS numeric_set,
  coalesce(CASE WHEN length({house1}) BETWEEN 1 AND 5 THEN {house1} END, CASE WHEN length({house2}) BETWEEN 1 AND 5 THEN {house2} END, {house3}) AS house_number,
  CASE country_cleaned {postal} END AS postal_code,
  {grams('trim(addr_alphanumeric)', 3)} AS char_3grams FROM n6),
s1 AS (SELECT * FROM ent WHERE entity_id LIKE 'S1-%'), tg AS (SELECT * FROM ent WHERE entity_id NOT LIKE 'S1-%')""" + (f",\ngt AS ({truth_sql()})" if view == "part" else "")


def postings(side: str, expression: str, name: str) -> str:
    return f"SELECT DISTINCT country_cleaned AS cc, unnest(list_distinct({expression})) AS key, entity_id AS {name} FROM {side} WHERE country_cleaned <> ''"


def exact(column: str) -> str:
    return f"SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id FROM s1 a JOIN tg b USING (country_cleaned, {column}) WHERE country_cleaned <> '' AND {column} IS NOT NULL AND CAST({column} AS VARCHAR) NOT IN ('', '[]')"


def overlap(column: str, least: int = 1, low: int = 1, high: int | None = None) -> str:
    keep = f"HAVING count(*) >= {low}" + (f" AND count(*) <= {high}" if high else "")
    return f"""SELECT s1_id, cand_id FROM ({postings('s1', column, 's1_id')}) a JOIN ({postings('tg', column, 'cand_id')}) b USING (cc, key)
JOIN (SELECT cc, key FROM ({postings('tg', column, 'cand_id')}) p GROUP BY cc, key {keep}) k USING (cc, key) GROUP BY s1_id, cand_id HAVING count(*) >= {least}"""


def ranked(column: str, low: int, high: int, strict: bool = False, probes: int | None = None, least_keys: int = 0) -> str:
    """(s1_id, cand_id, key_rank) of ranked probe keys and indexed postings."""
    join = "LEFT JOIN" if strict else "JOIN"
    side = f"(SELECT * FROM s1 WHERE len(list_distinct({column})) >= {least_keys}) s"
    return f"""SELECT r.s1_id, p.cand_id, r.key_rank FROM (SELECT s1_id, a.cc, a.key, row_number() OVER (PARTITION BY s1_id ORDER BY coalesce(df, 0), a.key) AS key_rank
 FROM ({postings(side, column, 's1_id')}) a {join} (SELECT cc, key, count(*) AS df FROM ({postings('tg', column, 'cand_id')}) q GROUP BY cc, key HAVING count(*) BETWEEN {low} AND {high}) d ON a.cc = d.cc AND a.key = d.key) r
 JOIN ({postings('tg', column, 'cand_id')}) p ON r.cc = p.cc AND r.key = p.key
 JOIN (SELECT cc, key FROM ({postings('tg', column, 'cand_id')}) q GROUP BY cc, key HAVING count(*) BETWEEN {low} AND {high}) d2 ON p.cc = d2.cc AND p.key = d2.key""" + (f" WHERE r.key_rank <= {probes}" if probes else "")


def capped(found: str, cap: int) -> str:
    return f"SELECT s1_id, cand_id FROM (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY min(key_rank), cand_id) AS r FROM ({found}) f GROUP BY s1_id, cand_id) WHERE r <= {cap}"


def similar(pairs: str, column: str, least: float, shared: int, cap: int) -> str:
    both = f"SELECT p.s1_id, p.cand_id, list_distinct(a.{column}) AS x, list_distinct(b.{column}) AS y FROM ({pairs}) p JOIN s1 a ON a.entity_id = p.s1_id JOIN tg b ON b.entity_id = p.cand_id"
    inter = "len(list_intersect(x, y))"
    good = f"SELECT s1_id, cand_id, 0 AS key_rank FROM ({both}) WHERE {inter} >= {shared} AND {inter} / (len(x) + len(y) - {inter}) >= {least}"
    return capped(good, cap)


def numeric_counts(high: int = 5000) -> str:
    p = postings("tg", "numeric_set", "cand_id")
    return f"SELECT s1_id, cand_id, count(*) AS n FROM ({postings('s1', 'numeric_set', 's1_id')}) a JOIN ({p}) b USING (cc, key) JOIN (SELECT cc, key FROM ({p}) q GROUP BY cc, key HAVING count(*) <= {high}) k USING (cc, key) GROUP BY s1_id, cand_id"


def ngram_top(n: int, k: int) -> str:
    padded = f"CASE WHEN name_no_accents = '' THEN [] ELSE {grams(chr(39) + '$' + chr(39) + ' || name_no_accents || ' + chr(39) + '$' + chr(39), n)} END"
    side = lambda t, i: f"SELECT cc, {i}, len(g) AS {i}_size, unnest(g) AS key FROM (SELECT country_cleaned AS cc, entity_id AS {i}, {padded} AS g FROM {t})"
    limit = "(SELECT least(1000, greatest(50, floor(count(*) * 0.01))) FROM tg)"
    kept = f"SELECT cc, key FROM ({side('tg', 'cand_id')}) q GROUP BY cc, key HAVING count(*) <= {limit}"
    return f"""SELECT s1_id, cand_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS rank FROM (
 SELECT s1_id, cand_id, count(*) / (s1_id_size + cand_id_size - count(*)) AS score FROM ({side('s1', 's1_id')}) a JOIN ({side('tg', 'cand_id')}) b USING (cc, key) JOIN ({kept}) k USING (cc, key)
 GROUP BY s1_id, cand_id, s1_id_size, cand_id_size HAVING count(*) >= CASE WHEN s1_id_size >= 4 THEN 2 ELSE 1 END)) WHERE rank <= {k}"""


def counts(pairs: str) -> str:
    return f"SELECT entity_id AS s1_id, coalesce(c, 0) AS candidates FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS c FROM (SELECT DISTINCT s1_id, cand_id FROM ({pairs}) pp) GROUP BY s1_id) n ON n.s1_id = entity_id"


def place(list_: str, at: str) -> str:
    return f"list_sort(list({list_}))[CAST({at} AS BIGINT) + 1]"


def nearest(column: str, p: float) -> str:
    return place(column, f"least(floor(count(*) * {p}), count(*) - 1)")


def evaluate(name: str, pairs: str) -> str:
    hits = f"SELECT s1_id, left(match_id, 2) AS src, CASE WHEN cand_id IS NULL THEN 0 ELSE 1 END AS hit FROM (SELECT DISTINCT s1_id, match_id FROM gt) g LEFT JOIN (SELECT DISTINCT s1_id AS i, cand_id FROM ({pairs}) pp) c ON c.i = g.s1_id AND c.cand_id = g.match_id"
    per = f"SELECT s1_id, count(*) FILTER (src = 'S2') AS t2, count(*) FILTER (src = 'S3') AS t3, sum(hit) FILTER (src = 'S2') AS h2, sum(hit) FILTER (src = 'S3') AS h3, min(hit) AS ok FROM ({hits}) GROUP BY s1_id"
    rate = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
    return f"""SELECT '{name}' AS route, true_s2, true_s3, retrieved_s2, retrieved_s3, {rate('(retrieved_s2 + retrieved_s3)', '(true_s2 + true_s3)')} AS recall, {rate('retrieved_s2', 'true_s2')} AS recall_s2, {rate('retrieved_s3', 'true_s3')} AS recall_s3, {rate('covered', 'n')} AS full_coverage,
 avg_candidates, median_candidates, max_candidates, p95_candidates FROM (SELECT CAST(sum(t2) AS BIGINT) AS true_s2, CAST(sum(t3) AS BIGINT) AS true_s3, CAST(coalesce(sum(h2), 0) AS BIGINT) AS retrieved_s2, CAST(coalesce(sum(h3), 0) AS BIGINT) AS retrieved_s3, count(*) AS n, sum(ok) AS covered FROM ({per})) x,
 (SELECT avg(candidates) AS avg_candidates, median(candidates) AS median_candidates, max(candidates) AS max_candidates, {nearest('candidates', 0.95)} AS p95_candidates FROM ({counts(pairs)}) cc) y"""
