"""DuckDB SQL of the plans in ``ledger``."""

from headwater.plans.ledger import COMMON, DELIVERIES, FEEDS, TOKEN_KEY, TOKEN_TIME
from headwater.plans.oracles import _H, _LOG, _REASONS, _UPSERT, ORACLES, _norm

_PAD = {mask: bytes(b ^ mask for b in TOKEN_KEY.ljust(64, b"\0")).hex() for mask in (0x36, 0x5C)}
_B64 = "rtrim(replace(replace(base64({0}), '+', '-'), '/', '_'), '=')"
_PATTERNS = {w: rf"(?i)(^|[^\p{{L}}\p{{N}}]){w}([^\p{{L}}\p{{N}}]|$)" for w in COMMON} | {"licence": "(?i)licensed?( under|$)", "rights": "(?i)all rights +reserved"}
_EACH = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS name FROM titles WHERE regexp_matches(title, '{p}')" for name, p in _PATTERNS.items())
_RUN = f"""
WITH RECURSIVE {_H}, {_REASONS},
accepted AS (
  SELECT doc_id, source, title, url, date, {_norm("title")} AS norm, row_number() OVER (ORDER BY doc_id) AS i,
    CASE WHEN regexp_matches(title, '(?i)licensed|license') THEN 'legal' WHEN regexp_matches(title, '\\|') THEN 'lists' WHEN regexp_matches(title, '!!') THEN 'shout' WHEN length(title) BETWEEN 1 AND 20 THEN 'short' ELSE "column" END AS "column"
  FROM reasons WHERE reason IS NULL),
walk AS (
  SELECT 0::BIGINT AS i, []::VARCHAR[] AS a, []::VARCHAR[] AS b, NULL::BIGINT AS kept
  UNION ALL
  SELECT r.i, CASE WHEN ok THEN list_append(a, url) ELSE a END, CASE WHEN ok THEN list_append(b, norm) ELSE b END, CASE WHEN ok THEN doc_id END
  FROM (SELECT r.*, w.a, w.b, NOT list_contains(w.a, r.url) AND NOT list_contains(w.b, r.norm) AS ok FROM walk w JOIN accepted r ON r.i = w.i + 1) r),
uniq AS (SELECT a.* FROM accepted a JOIN walk w ON w.kept = a.doc_id),
per AS (SELECT *, row_number() OVER (PARTITION BY "column", source ORDER BY date DESC, doc_id) AS r1 FROM uniq),
used AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY date DESC, doc_id) AS rank FROM per WHERE r1 <= 7 QUALIFY rank <= 36)"""
#: The walk of ``trend_top``, and what it keeps.
_TOP = ORACLES["trend_top"].rsplit("SELECT row_number()", 1)[0].rstrip() + ", top AS (SELECT row_number() OVER (ORDER BY i) AS rank, term, tenths FROM walk WHERE term IS NOT NULL)"

LEDGER = {
    "summary_clean": f"""WITH {_H}, plain AS (SELECT doc_id, trim(regexp_replace(title, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS t FROM heads)
SELECT doc_id, t || CASE WHEN doc_id % 5 = 0 THEN '…' ELSE '' END AS summary FROM plain""",
    "trend_report": f"""{_TOP} SELECT rank, term, (m.tenths / 10.0)::DOUBLE AS score, count, sources, "column" FROM top JOIN mined m USING (term)""",
    "trend_items": f"""{_TOP} SELECT rank, term, unnest(ids) AS id FROM top JOIN mined m USING (term)""",
    "item_heat_selected": f"""{_TOP}, x AS (SELECT unnest(ids) AS id, m.tenths FROM top JOIN mined m USING (term)), y AS (SELECT id, sum(tenths) AS t FROM x GROUP BY id)
SELECT heads.id, (coalesce(t, 0) / 10.0)::DOUBLE AS heat FROM heads LEFT JOIN y ON heads.id = y.id""",
    "composed_run": f"""{_RUN} SELECT "column", rank, doc_id, substr(sha1(url), 1, 10) AS id, url, title FROM used""",
    "composed_run_report": f"""{_RUN},
feeds AS (SELECT unnest({FEEDS + ["other"]}) AS source),
told AS (SELECT CASE WHEN list_contains({FEEDS}, source) THEN source ELSE 'other' END AS source, reason, doc_id FROM reasons)
SELECT f.source, count(o.doc_id) AS found, count(*) FILTER (reason = 'undated') AS undated, count(*) FILTER (reason = 'old') AS old, count(*) FILTER (reason = 'blocked') AS blocked,
  count(*) FILTER (reason = 'noise') AS noise, count(*) FILTER (reason = 'excluded') AS excluded,
  count(o.doc_id) FILTER (reason IS NULL AND u.doc_id IS NULL) AS duplicated, count(*) FILTER (u.doc_id IS NOT NULL AND s.doc_id IS NULL) AS limited, count(s.doc_id) AS used
FROM feeds f LEFT JOIN told o ON o.source = f.source LEFT JOIN uniq u ON u.doc_id = o.doc_id LEFT JOIN used s ON s.doc_id = o.doc_id GROUP BY f.source""",
    "stream_fault_isolation": """
SELECT event_type AS name, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS state, count(*) FILTER (event_type <> 'error') AS written
FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY event_type""",
    "versioned_upsert": _UPSERT,
    "versioned_history": f"""
WITH {_LOG}, ends AS (SELECT unnest({list(range(1, len(DELIVERIES) + 1))}) AS version, unnest({list(DELIVERIES)}) AS last)
SELECT version::BIGINT AS version, count(DISTINCT id) AS n, max(heat) AS heat FROM ends JOIN log ON day(ts) <= last GROUP BY version""",
    "stream_expiring_state": f"""
WITH log AS (SELECT user_id * 31 + day(ts) AS id, event_id AS seq, ts, event_type AS title, CASE WHEN value > 50 THEN 'img' || event_id END AS image, props AS url, value AS heat FROM events)
SELECT id, arg_max(title, seq) AS title, arg_max(image, seq) FILTER (image IS NOT NULL) AS image, arg_min(url, seq) AS url,
  floor(epoch(min(ts)))::BIGINT AS first_seen, max(heat) AS heat
FROM log GROUP BY id HAVING epoch_ms(min(ts)) + 10 * 86400000 > (SELECT epoch_ms(max(ts)) FROM events) - 86400000""",
    "date_parse_zones": """
SELECT event_id, (CASE event_id % 10 WHEN 3 THEN epoch_us(ts) // 100000 * 100 WHEN 4 THEN epoch_us(ts) // 1000 WHEN 5 THEN epoch_us(ts) // 60000000 * 60000 WHEN 6 THEN epoch_us(ts) // 60000000 * 60000
  WHEN 7 THEN epoch_us(ts) // 86400000000 * 86400000 WHEN 8 THEN epoch_us(ts) // 60000000 * 60000 WHEN 9 THEN NULL ELSE epoch_us(ts) // 1000000 * 1000 END)::BIGINT AS epoch_ms FROM events""",
    "token_checks_signed": f"""
WITH told AS (
  SELECT event_id AS n, floor(epoch(ts))::BIGINT AS t, CASE WHEN event_id % 17 = 0 THEN '{{"alg":"none"}}' ELSE '{{"alg":"HS256"}}' END AS h,
    '{{"sub":"' || user_id || '","exp":' || floor(epoch(ts))::BIGINT || CASE WHEN event_id % 5 = 0 THEN ',"nbf":' || (floor(epoch(ts))::BIGINT - 86400) ELSE '' END
    || CASE WHEN event_id % 11 = 0 THEN ',"iss":"other"' ELSE ',"iss":"desk"' END || CASE WHEN event_id % 13 = 0 THEN ',"aud":"b"' WHEN event_id % 2 = 0 THEN ',"aud":["a","b"]' ELSE ',"aud":"a"' END || '}}' AS c
  FROM events),
bodies AS (SELECT *, {_B64.format("encode(h)")} || '.' || {_B64.format("encode(c)")} AS body FROM told),
hashed AS (SELECT *, sha256(unhex('{_PAD[0x5C]}') || unhex(sha256(unhex('{_PAD[0x36]}') || encode(body)))) AS mac FROM bodies)
SELECT n AS event_id, {_B64.format("unhex(mac)")} AS signature,
  CASE WHEN n % 19 = 0 THEN 'malformed' WHEN n % 23 = 0 AND n % 17 <> 0 THEN 'signature' WHEN n % 29 = 0 AND n % 23 <> 0 THEN 'malformed' WHEN n % 17 = 0 THEN 'algorithm' WHEN t <= {TOKEN_TIME} THEN 'expired'
    WHEN n % 5 = 0 AND t - 86400 > {TOKEN_TIME} THEN 'early' WHEN n % 11 = 0 THEN 'issuer' WHEN n % 13 = 0 THEN 'audience' END AS refused
FROM hashed""",
    "text_search_index": f"""
WITH {_H},
titles AS (SELECT doc_id AS id, 'title' AS part, lower(title) AS text FROM heads),
phones AS (SELECT c_custkey AS id, 'phone' AS part, '55119' || lpad(c_custkey::VARCHAR, 8, '1') AS text FROM customer),
texts AS (SELECT * FROM titles UNION ALL SELECT * FROM phones),
needles AS (
  SELECT id AS needle_id, part, substr(text, 3, 7) AS needle FROM titles WHERE id % 25 = 0
  UNION ALL SELECT id + 1, part, substr(text, 1, 2) FROM titles WHERE id % 50 = 0
  UNION ALL SELECT id, part, right(text, 4) FROM phones WHERE id % 40 = 0)
SELECT DISTINCT needle_id, id, t.part FROM needles n JOIN texts t ON n.part = t.part AND n.needle <> '' AND contains(t.text, n.needle)""",
    "pattern_index": f"""
WITH {_H}, titles AS MATERIALIZED (SELECT doc_id, title FROM heads)
{_EACH}""",
}
