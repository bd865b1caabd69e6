"""DuckDB SQL for the plans of ``serving``."""

from __future__ import annotations

from .oracles import _ANCHOR, _H, _NOW, _REASONS, _decode, _norm

SERVING = {
    "entities_full": rf"WITH r AS (SELECT doc_id, '&ccedil;&#231;&#xE7; &amp;eacute; &euro; &nosuch; &#0; a&b ' || regexp_extract(text, '^[^\n]*', 0) AS t FROM documents) SELECT doc_id, {_decode('t')} AS title FROM r",
    "date_parse_localised": "SELECT event_id, floor(epoch(date_trunc('minute', ts)))::BIGINT AS epoch FROM events",
    "absolute_url": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) AS root, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://[^/]*(/.*/)?', 0) AS dir FROM pages),
a AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN root || '/img/a.png' WHEN 1 THEN 'https://cdn.example/b.png' WHEN 2 THEN regexp_replace(dir, '/*$', '/') || 'c.png' WHEN 3 THEN 'https://x.example/d.png' END AS u FROM p)
SELECT page_id, regexp_replace(u, '^http://', 'https://') AS image FROM a""",
    "pick_image": "SELECT page_id, CASE WHEN page_id % 7 * 100 >= 300 THEN 'https://m.example/' || page_id || '.jpg' ELSE 'https://m.example/t.jpg' END AS image FROM pages",
    "feed_rules": f"""WITH {_H} SELECT source, CASE WHEN source = 'src3' AND regexp_matches(url, '/1[0-9]*$') THEN 'noise' WHEN source = 'src2' AND NOT regexp_matches(title, '(?i)a') THEN 'not_included'
  WHEN source = 'src1' AND regexp_matches(title, '(?i)ll') THEN 'excluded' ELSE 'kept' END AS reason, count(*) AS n FROM heads GROUP BY 1, 2""",
    "edition_latest": "SELECT strftime(ts, '%G-W%V') AS id, count(*) AS items, max(value) AS heat FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 1",
    "pending_backlog": "SELECT o_orderkey, epoch(o_orderdate::TIMESTAMP)::BIGINT AS updated_at FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-12-31 23:58:00' ORDER BY o_orderdate, o_orderkey LIMIT 20",
    "sync_updates": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate::TIMESTAMP)::BIGINT END AS synced_at, CASE WHEN o_orderstatus = 'P' THEN left('failed: ' || o_orderpriority, 12) END AS sync_error FROM orders",
    "schedule_bounds": f"SELECT ts > {_NOW} - INTERVAL 15 DAY + INTERVAL 60 SECOND AND ts <= {_NOW} + INTERVAL 15 DAY AS allowed, count(*) AS n FROM events GROUP BY 1",
    "text_search": f"WITH {_H} SELECT doc_id, title FROM heads WHERE contains(lower(title || ' ' || source), 'de') ORDER BY date DESC, doc_id LIMIT 80",
    "token_claims": """WITH c AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 'login' ELSE 'read' END END AS purpose, CASE WHEN event_id % 7 <> 0 THEN floor(epoch(ts))::BIGINT END AS exp FROM events)
SELECT *, coalesce(purpose = 'login' AND exp > epoch(TIMESTAMP '2024-01-15')::BIGINT, false) AS accepted FROM c""",
    "cookie_lookup": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'pt' END AS lang, '1' AS a FROM events",
    "week_label": """WITH s AS (SELECT ts, ts::DATE - 6 AS b FROM events)
SELECT day(b) || CASE WHEN strftime(b, '%Y%m') = strftime(ts, '%Y%m') THEN '' ELSE strftime(b, ' %b') END || ' to ' || day(ts) || strftime(ts, ' %b %Y') AS label, count(*) AS n FROM s GROUP BY 1""",
    "name_parts": """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS first, CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 2 = 0 THEN 'da Silva' ELSE '' END AS rest,
  CASE WHEN c_custkey % 9 = 0 THEN '' ELSE upper(left(c_name, 1)) || CASE WHEN c_custkey % 2 = 0 THEN 'S' ELSE '' END END AS initials FROM customer""",
    "edition_items": f"""WITH {_H} SELECT doc_id, CASE "column" WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE '' END AS column_name, left(title, 40) AS title, left(summary, 60) AS summary, url FROM heads WHERE title <> ''""",
    "request_validation": "SELECT conv_id, CASE WHEN count(*) > 25 THEN 'items' WHEN count(*) FILTER (text IS NULL) > 0 THEN 'text' WHEN max(length(text)) > 600 THEN 'length' ELSE 'ok' END AS verdict FROM conversations GROUP BY 1",
    "used_sources": f"WITH {_H}, {_REASONS} SELECT DISTINCT source, replace({_norm('source')}, ' ', '-') AS slug FROM reasons WHERE reason IS NULL",
    "version_probe": "SELECT page_id, CASE WHEN page_id % 4 > 0 THEN '2024-01-0' || (page_id % 9 + 1) || 'T00:00:00Z' END AS version FROM pages",
    "trend_lookback": f"""WITH {_H}, g AS (SELECT doc_id, (epoch({_ANCHOR}) - epoch(date)) / 3600 AS age FROM heads),
n AS (SELECT CASE WHEN count(*) FILTER (age <= 48) >= 60 THEN 48 WHEN count(*) FILTER (age <= 96) >= 60 THEN 96 ELSE 1e18 END AS hours FROM g) SELECT doc_id FROM g, n WHERE age <= hours""",
    "inference_metrics": "SELECT CASE WHEN quality = 1 THEN 'cached' WHEN length(text) % 5 = 0 THEN 'dropped' ELSE 'translated' END AS state, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
}
