"""DuckDB SQL for the plans of ``newsroom``."""

from __future__ import annotations

from .oracles import _H, _REASONS

_EN, _FR = "('the','of','and','in','that','is')", "('le','de','la','les','que','est')"
_MADE = f"""{_H}, made AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN title WHEN 1 THEN 'le ' || lower(title) ELSE summary END AS made FROM heads),
w AS (SELECT *, regexp_extract_all(lower(title), '[\\p{{L}}’'']+') AS a, regexp_extract_all(lower(made), '[\\p{{L}}’'']+') AS b FROM made),
c AS (SELECT *, len(list_filter(b, lambda x: x IN {_EN})) AS en, len(list_filter(b, lambda x: x IN {_FR})) AS fr FROM w),
judged AS (SELECT *, (a = b AND (en >= 1 OR len(b) >= 4)) OR (en >= 2 AND en > fr) AS un FROM c)"""

NEWSROOM = {
    "feed_parse_atom": rf"""WITH {_H} SELECT source, doc_id // 1000 AS part, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) - 1 AS ord,
  trim(regexp_replace(title, '[ \t\r\n\f]+', ' ', 'g')) AS title, url FROM heads WHERE title <> ''""",
    "feed_faults": "SELECT s_name AS name, (s_suppkey % 4 = 3)::BIGINT AS entries, CASE s_suppkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 2 THEN 'no entries' END AS error FROM supplier",
    "charset_decode": r"SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN '<?xml encoding=''windows-1252''?>“' || doc_id || '”€é' ELSE regexp_extract(text, '^[^\n]*', 0) END AS text FROM documents",
    "tag_attributes": "SELECT page_id, url AS src, 'a & b' AS alt, '3' AS width, 3::BIGINT AS n FROM pages",
    "block_scope": "SELECT page_id, page_id % 3 = 0 OR page_id % 5 = 0 AS blocked FROM pages",
    "run_totals": f"""WITH {_H}, {_REASONS} SELECT CASE WHEN grouping("column") = 1 THEN 'all' ELSE coalesce("column", 'none') END AS "column", count(*) AS found, count(*) FILTER (reason IS NULL) AS used,
  count(*) FILTER (reason = 'undated') AS undated, count(*) FILTER (reason = 'old') AS old, count(*) FILTER (reason = 'blocked') AS blocked, count(*) FILTER (reason = 'noise') AS noise, count(*) FILTER (reason = 'excluded') AS excluded
FROM reasons GROUP BY ROLLUP ("column")""",
    "untranslated_full": f"WITH {_MADE} SELECT doc_id, un AS untranslated FROM judged",
    "cache_gate": f"WITH {_MADE} SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND NOT un THEN made END AS cached, CASE WHEN doc_id % 2 = 0 AND NOT un THEN 'hit' ELSE 'miss' END AS state FROM judged",
    "pass_through": f"""WITH {_H} SELECT doc_id, "column" AS lang, CASE WHEN "column" = 'en' THEN upper(title) ELSE title END AS title,
  CASE WHEN doc_id % 4 = 0 THEN '' WHEN "column" <> 'en' THEN summary WHEN doc_id % 5 > 0 THEN upper(summary) ELSE '' END AS summary FROM heads WHERE "column" <> 'en' OR doc_id % 3 > 0""",
    "restored_case": "SELECT c_custkey, 'Novo iPhone da NASA diz Musk ' || c_custkey AS title FROM customer",
    "snapshot_json": """SELECT doc_id, '{"doc_id":' || doc_id || ',"source":"\\u003c/' || source || '","column":"' || lang || '"}' AS json FROM documents""",
    "csv_export": """SELECT c_custkey, c_custkey || ';' || CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END || c_acctbal || ';' || CASE WHEN c_custkey % 2 = 0 THEN '"a;""b\"""' ELSE '' END || ';' || c_mktsegment AS line FROM customer""",
    "edition_clip": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) SELECT conv_id, turn, left(text, 50) AS text FROM r WHERE r <= 20 AND coalesce(text, '') <> ''",
    "draft_upsert": """WITH n AS (SELECT o_custkey + 3 AS id, max(o_orderpriority) AS c FROM orders GROUP BY 1), o AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'sent' ELSE 'draft' END AS status, c_mktsegment AS c FROM customer)
SELECT coalesce(o.id, n.id) AS id, coalesce(status, 'draft') AS status, CASE WHEN n.id IS NOT NULL AND coalesce(status, 'draft') = 'draft' THEN n.c ELSE o.c END AS content, (n.id IS NOT NULL AND coalesce(status, 'draft') = 'draft')::BIGINT AS affected FROM o FULL JOIN n ON o.id = n.id""",
    "catch_up_weeks": """WITH l AS (SELECT ts, ts - INTERVAL 3 HOUR AS l FROM events) SELECT strftime(l, '%G-W%V') AS week, floor(epoch(min(ts)))::BIGINT AS at FROM l WHERE isodow(l) > 5 OR (isodow(l) = 5 AND hour(l) * 60 + minute(l) >= 405) GROUP BY 1""",
    "request_router": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) AS nth FROM events)
SELECT CASE WHEN event_id % 31 = 0 THEN '301' WHEN event_type NOT IN ('view', 'click', 'signup', 'purchase') THEN '405' WHEN event_id % 17 = 0 THEN '403' WHEN event_id % 29 = 0 THEN '302' WHEN nth > 1 THEN '429'
  WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 2 = 0 THEN '503' ELSE '404' END ELSE '200' END AS decision, count(*) AS n FROM r GROUP BY 1""",
    "source_names": "SELECT doc_id, CASE WHEN source = 'src3' THEN source ELSE upper(source) END AS name FROM documents",
    "map_entries": "SELECT event_id, 'a' AS key, event_type AS value FROM events UNION ALL SELECT event_id, 'b', event_id::VARCHAR FROM events",
    "subscriber_list": "SELECT o_orderkey, epoch(o_orderdate::TIMESTAMP)::BIGINT AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5000",
    "edition_by_id": "SELECT event_type, count(*) AS items, max(value) AS heat FROM events WHERE strftime(ts, '%G-W%V') = '2024-W02' GROUP BY 1",
    "json_between_braces": "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN (props->>'$.k')::BIGINT END AS k FROM events",
    "paragraphs": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, coalesce(array_to_string(list_transform(p, lambda x: '<p>' || replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</p>'), ''), '') AS html FROM p""",
}
