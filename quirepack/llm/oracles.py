"""DuckDB's forms of the queries that SQL can express, written from their contracts."""

from __future__ import annotations

from .sharding import PRIME, SLOT_PARTS, STRIDE

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _numbered(table: str, key: str, words: str) -> str:
    """Rows with a number r of their own and their list of words w."""
    return f"SELECT row_number() OVER () AS r, {key}, {words} AS w FROM {table}"


def jaccard(n: int = 4, num: int = 85, den: int = 100) -> str:
    words = _SPACED.format(_LOWER.format("coalesce(text, '')"))
    return f"""
WITH RECURSIVE d AS ({_numbered("documents", "doc_id", words)}),
g AS (SELECT DISTINCT r, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
s AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
k AS (SELECT a AS r, a AS o FROM l UNION SELECT k.r, l.b FROM k JOIN l ON l.a = k.o),
m AS (SELECT k.r, min(d.doc_id) AS component FROM k JOIN d ON d.r = k.o GROUP BY k.r)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id FROM d LEFT JOIN s USING (r) LEFT JOIN m USING (r)"""


def decontamination(window: int = 13) -> str:
    words = _ALNUM.format(_LOWER.format("coalesce(text, '')"))
    return f"""
WITH d AS ({_numbered("documents", "doc_id", words)}),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, w, least(len(w), {window}) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
v AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
z AS (SELECT DISTINCT n FROM b),
o AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, z WHERE len(w) >= n)),
f AS (SELECT o.r, o.i, o.n, v.item FROM o JOIN v USING (n, x)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM f) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


def sharding(shards: int) -> str:
    """With equal weights, and one more shard for grown_shard. The checksum is folded over the bytes by its table."""
    def best(count: int) -> str:
        scores = []
        for i in range(count):
            y = f"((a + {(i + 1) * STRIDE}) % {PRIME})"
            y = f"(({y} * {y} + b) % {PRIME})"
            y = f"(({y} * {y} + a + {i}) % {PRIME})"
            scores.append(f"-ln(({y} + 0.5) / {PRIME}.0)")
        return f"list_position([{', '.join(scores)}], list_min([{', '.join(scores)}])) - 1"

    half = lambda at: f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\\N')), {at}, 8) AS BIGINT) % {PRIME}"
    return f"""
WITH RECURSIVE e AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END, k + 1 FROM e WHERE k < 8),
q AS (SELECT list(v ORDER BY i) AS q FROM e WHERE k = 8),
t AS (SELECT doc_id, coalesce(text, '') AS x, {half(1)} AS a, {half(9)} AS b FROM documents),
c AS (SELECT doc_id, a, b, CAST(octet_length(encode(x)) + 1 AS BIGINT) AS size,
  xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda s, y: xor(s // 256, q[CAST(xor(s, y) & 255 AS INTEGER) + 1]))) AS text_crc32 FROM t, q),
s AS (SELECT *, {best(shards)} AS shard, {best(shards + 1)} AS grown_shard FROM c)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY a % {SLOT_PARTS} * 16 + (text_crc32 & 15), a, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM s"""


def substrings(window: int = 35) -> str:
    words = _SPACED.format("coalesce(text, '')")
    return f"""
WITH d AS ({_numbered("documents", "doc_id", words)}),
o AS (SELECT r, i, array_to_string(w[i:i + {window - 1}], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY x) AS n FROM o) WHERE n > 1),
h AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS i FROM c),
k AS (SELECT e.r, string_agg(e.x, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) e ANTI JOIN h ON h.r = e.r AND h.i = e.i GROUP BY e.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


def archives() -> str:
    """A SHA-1 of 40 hexadecimal digits is eight times five of them: four base32 digits each."""
    digits = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    five = "CAST('0x' || substr(z, 5 * CAST(k // 4 AS INTEGER) + 1, 5) AS BIGINT)"
    digit = f"substr({digits}, CAST({five} // [32768, 1024, 32, 1][CAST(k % 4 AS INTEGER) + 1] % 32 AS INTEGER) + 1, 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS z FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS best FROM p)
SELECT page_id, CAST(octet_length(encode(x)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda k: {digit}), '') AS payload_digest,
  CASE WHEN best IS NULL OR page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN best END AS refers_to FROM m"""
