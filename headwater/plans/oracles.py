"""DuckDB SQL for the rows of each plan, written from the meaning of the operator."""

from __future__ import annotations

from html.entities import name2codepoint

_TRACK = "(?i)^(utm_[a-z_]*|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)"
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_ANCHOR = "TIMESTAMP '2024-02-01 00:00:00'"
_SPACE = r"[ \t\r\n\f\x{00a0}\x{200b}]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _truncate(t: str, n: int) -> str:
    word = f"regexp_extract(substr({t}, 1, {n + 1}), '(?s)^(.*) [^ ]*$', 1)"
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE regexp_replace(CASE WHEN length({word}) > {int(n * 0.6)} THEN {word} ELSE substr({t}, 1, {n}) END, '[ .,;:!?-]+$', '') || '…' END"


def _strip_tags(h: str) -> str:
    for tag in ("script", "style", "figure", "figcaption", "iframe", "noscript"):
        h = f"regexp_replace({h}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    h = f"regexp_replace({h}, '(?s)<!--.*?-->', '', 'g')"
    h = f"regexp_replace({h}, '(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)(?:\\s[^>]*)?/?>', ' ', 'g')"
    return f"regexp_replace({h}, '<[^>]*>', '', 'g')"


def _decode(t: str) -> str:
    """Names and code points from the standard library's table, written apart from the implementation."""
    names = "MAP {" + ", ".join(f"{_q(n)}: {_q(' ' if n == 'nbsp' else chr(c))}" for n, c in [*name2codepoint.items(), ("apos", 39)]) + "}"
    code = "CASE WHEN e[2] IN ('x', 'X') THEN TRY_CAST('0x' || e[3:] AS BIGINT) ELSE TRY_CAST(e[2:] AS BIGINT) END"
    char = f"CASE WHEN e LIKE '#%' THEN CASE WHEN {code} BETWEEN 1 AND 1114111 AND NOT {code} BETWEEN 55296 AND 57343 THEN chr(({code})::INTEGER) ELSE '' END ELSE {names}[e] END"
    for _ in range(2):
        pieces = f"list_transform(string_split({t}, '&'), lambda x, i: struct_pack(x := x, i := i, e := regexp_extract(x, '^(#[0-9]{{1,9}}|#[xX][0-9a-fA-F]{{1,8}}|[A-Za-z][A-Za-z0-9]*);', 1)))"
        one = char.replace("e[", "s.e[").replace("WHEN e ", "WHEN s.e ").replace("}[e]", "}[s.e]").replace("[s.s.e", "[s.e")
        t = f"array_to_string(list_transform({pieces}, lambda s: CASE WHEN s.i = 1 THEN s.x WHEN s.e = '' THEN '&' || s.x ELSE coalesce(({one}) || regexp_replace(s.x, '^[^;]*;', ''), '&' || s.x) END), '')"
    return t


def _collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{_SPACE}', ' ', 'g'))"


def _norm(t: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({t})), '[^a-z0-9]+', ' ', 'g'))"


_TIDY = r"regexp_replace(regexp_replace(regexp_extract(text, '^[^\n]*', 0), '(?i)\s+via @\w+(?:\s*,\s*@\w+)*\s*$', '', 'g'), '\s+\|\s+(?:Site|Blog|News)$', '', 'g')"
_H = rf"""
tidied AS (SELECT *, {_TIDY} AS raw_title FROM documents),
heads AS (
  SELECT doc_id, substr(sha1(doc_id::VARCHAR), 1, 10) AS id, lang AS "column", source,
    {_truncate("raw_title", 200)} AS title,
    trim(substr(replace(regexp_replace(text, '^[^\n]*\n?', ''), chr(10), ' '), 1, 220)) AS summary,
    'https://' || source || '.example/' || n_chars AS url,
    least(make_timestamp((1706745600 - (doc_id * 37 % 20000) * 60) * 1000000), {_ANCHOR}) AS date
  FROM tidied)"""
_BLOCK, _SPONSORED = r"(?i)\b(?:idiot|moron|scum|trash)\b", "(?i)all rights reserved"
_BOTH = "title || ' ' || chr(10) || ' ' || summary"
_REASONS = rf"""
reasons AS (
  SELECT *, CASE
    WHEN date IS NULL OR epoch_ms(date) = 0 THEN 'undated'
    WHEN date < {_ANCHOR} - INTERVAL 10 DAY THEN 'old'
    WHEN regexp_matches({_BOTH}, '{_BLOCK}') THEN 'blocked'
    WHEN regexp_matches(title, '(?:!!|\$\$\$|###|%%%)') OR regexp_matches({_BOTH}, '{_SPONSORED}') THEN 'noise'
    WHEN source = 'src19' THEN 'noise'
    WHEN source = 'src7' AND NOT regexp_matches(title, '(?i)\bthe\b') THEN 'excluded' END AS reason
  FROM heads)"""
_WORD = r"regexp_replace(regexp_replace(raw, '^[\p{P}|]+|[\p{P}|]+$', '', 'g'), '(?i)[''’]s$', '')"
_TOKENS = rf"""
pieces AS (SELECT doc_id, source, string_split_regex(title, '[ \t\r\n]+') AS l FROM heads),
raws AS (SELECT doc_id, source, unnest(l) AS raw, unnest(range(len(l))) AS i FROM pieces),
toks AS (SELECT doc_id, source, i, {_WORD} AS w, regexp_matches(raw, '[\p{{P}}|]$') AS stop FROM raws)"""
_WATCH = """
terms(term, pattern) AS (VALUES ('the', '\\bthe\\b'), ('licence', '(?i)licen[sc]e'), ('is', '\\bis\\b'), ('der', '\\bder\\b'), ('que', '\\bque\\b'), ('was', '\\bwas\\b'), ('for', '\\bfor\\b'), ('with', '\\bwith\\b'))"""
_SCORED = rf"""
hits AS (SELECT h.*, t.term FROM heads h JOIN terms t ON regexp_matches(h.title, t.pattern) WHERE h.date >= {_ANCHOR} - INTERVAL 96 HOUR),
dominant AS (
  SELECT term, "column" FROM (
    SELECT term, "column", row_number() OVER (PARTITION BY term ORDER BY count(DISTINCT id) DESC, coalesce(list_position(['en','fr','de','es'], "column"), 99)) AS r
    FROM hits GROUP BY term, "column") WHERE r = 1),
scored AS (
  SELECT h.term, count(DISTINCT id) AS count, count(DISTINCT source) AS sources, any_value(d."column") AS "column",
    (count(DISTINCT source) * 12 + sum(CASE WHEN epoch({_ANCHOR}) - epoch(date) < 43200 THEN 16 WHEN epoch({_ANCHOR}) - epoch(date) < 86400 THEN 13 ELSE 10 END)) AS tenths,
    list(id ORDER BY date DESC, id) AS ids
  FROM hits h JOIN dominant d ON h.term = d.term GROUP BY h.term HAVING count(DISTINCT id) >= 2 AND count(DISTINCT source) >= 2)"""
_AGE = f"(epoch({_ANCHOR}) - epoch(date))"
#: Runs as islands between words that cannot name anything; one row for a word, in the order of the title.
_MINED = rf"""
{_TOKENS}, {_WATCH},
tc AS (SELECT source FROM toks WHERE i > 0 AND length(w) > 3 AND regexp_matches(w, '^\p{{L}}') AND lower(w) NOT IN ('the','is','it','der','la')
  GROUP BY source HAVING count(*) >= 12 AND count(*) FILTER (regexp_matches(w, '^\p{{Lu}}')) / count(*) > 0.6),
span AS (SELECT CASE WHEN count(*) FILTER ({_AGE} <= 48 * 3600) >= 60 THEN 48 WHEN count(*) FILTER ({_AGE} <= 96 * 3600) >= 60 THEN 96 ELSE 1e15 END AS hours FROM heads),
pool AS (SELECT heads.*, source IN (FROM tc) AS shouts FROM heads, span WHERE {_AGE} <= hours * 3600),
own AS (SELECT t.doc_id, t.i, t.w, t.stop, p.shouts, regexp_matches(w, '^.+\p{{Lu}}') AS odd, regexp_matches(w, '^\p{{Lu}}') AS cap, length(w) >= 2 AND lower(w) NOT IN ('the','is','it','der','la') AS plain FROM toks t JOIN pool p USING (doc_id)),
known AS (SELECT DISTINCT w FROM own WHERE NOT shouts AND i > 0 AND plain AND (odd OR cap)),
fit AS (SELECT *, coalesce(plain AND (odd OR cap) AND regexp_matches(w, '^\p{{L}}[\p{{L}}\p{{N}}.+&''’-]*$') AND regexp_matches(w, '\p{{L}}.*\p{{L}}') AND (i > 0 OR odd OR w IN (FROM known)), false) AS usable FROM own),
cuts AS (SELECT *, (NOT usable)::INT + coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY i)::INT, 0) AS cut FROM fit),
isle AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM cuts),
runs AS (SELECT doc_id, run, any_value(shouts) AS shouts, (list(w ORDER BY i))[1:3] AS ws, (list(odd ORDER BY i))[1:3] AS odds FROM isle WHERE usable GROUP BY doc_id, run),
entries AS (
  SELECT doc_id, array_to_string(ws, ' ') AS term, 0 AS kind, run, 0 AS j FROM runs WHERE NOT shouts OR NOT list_contains(odds, false)
  UNION ALL SELECT doc_id, ws[j], 1, run, j FROM runs, range(1, 4) r(j) WHERE len(ws) > 1 AND j <= len(ws)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, run, j) - 1 AS k FROM entries),
found AS (SELECT * FROM numbered n WHERE (kind = 0 OR regexp_matches(term, '^.+\p{{Lu}}') OR term IN (FROM known)) AND lower(term) NOT IN ('the','is','it','der','la')
  AND NOT regexp_matches(term, '{_BLOCK}') AND NOT EXISTS (SELECT 1 FROM terms t WHERE regexp_matches(n.term, t.pattern))),
order_of AS (SELECT term, list_position(['the', 'licence', 'is', 'der', 'que', 'was', 'for', 'with'], term) AS k FROM terms),
met AS (SELECT p.doc_id, t.term, true AS watched, o.k FROM pool p JOIN terms t ON regexp_matches(p.title, t.pattern) JOIN order_of o ON o.term = t.term
  UNION ALL SELECT doc_id, term, false, k FROM found),
once AS (SELECT doc_id, term, bool_or(watched) AS watched, min(k) AS k FROM met GROUP BY ALL),
hit AS (SELECT o.*, p.id, p.source, p."column", p.date FROM once o JOIN pool p USING (doc_id)),
lead AS (SELECT term, "column" FROM (SELECT term, "column", row_number() OVER (PARTITION BY term ORDER BY count(*) DESC, coalesce(list_position(['en','fr','de','es'], "column"), 99)) AS r FROM hit GROUP BY term, "column") WHERE r = 1),
mined AS (
  SELECT h.term, count(*) AS count, count(DISTINCT source) AS sources, any_value(l."column") AS "column", list(id) AS ids, min((doc_id, NOT watched, k)) AS place,
    count(DISTINCT source) * 12 + sum(CASE WHEN {_AGE} < 43200 THEN 16 WHEN {_AGE} < 86400 THEN 13 ELSE 10 END) AS tenths
  FROM hit h JOIN lead l ON h.term = l.term GROUP BY h.term HAVING count(*) >= CASE WHEN bool_or(watched) THEN 2 ELSE 3 END AND count(DISTINCT source) >= 2)"""
_SUBS = """
subs AS (
  SELECT c_custkey,
    CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN 'x@y' ELSE c_name END AS name,
    CASE WHEN c_custkey % 5 = 0 THEN 'u' || c_custkey || '@mail' ELSE 'u' || c_custkey || '@mail.example' END AS email,
    CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '+55 (11) 9' || lpad(c_custkey::VARCHAR, 8, '1') ELSE '0' || lpad(c_custkey::VARCHAR, 6, '4') END AS phone,
    c_acctbal > 0 AS consent
  FROM customer),
digits AS (SELECT *, regexp_replace(regexp_replace(phone, '[^0-9]', '', 'g'), '^00', '') AS g FROM subs),
nat AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(g, '^55[0-9]{10,11}$') THEN substr(g, 3) ELSE g END, '^0', '') AS n FROM digits),
phones AS (SELECT *, CASE WHEN regexp_matches(phone, '^\\s*(\\+|00)') AND NOT regexp_matches(g, '^55') AND regexp_matches(g, '^[1-9][0-9]{7,14}$') THEN '+' || g WHEN regexp_matches(n, '^[1-9][1-9](9[0-9]{8}|[2-5][0-9]{7})$') THEN '+55' || n END AS e164 FROM nat)"""
_CACHE = "cache AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'q' || toxic ELSE '' END AS cached FROM labels)"
_LOG = "log AS (SELECT user_id AS id, event_id AS seq, ts, event_type AS title, CASE WHEN value > 50 THEN 'img' || event_id END AS image, props AS url, value AS heat FROM events)"
_UPSERT = f"""WITH {_LOG}
SELECT id, arg_max(title, seq) AS title, arg_max(image, seq) FILTER (image IS NOT NULL) AS image, arg_min(url, seq) AS url,
  floor(epoch(min(ts)))::BIGINT AS first_seen, max(heat) AS heat FROM log GROUP BY id"""
_RATE = """SELECT user_id, epoch(time_bucket(INTERVAL 60 MINUTE, ts))::BIGINT AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1"""

ORACLES = {
    "url_clean": rf"""
WITH p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS w FROM pages),
q AS (SELECT *, regexp_extract(w, '^[^?]*', 0) AS base, regexp_extract(w, '\?(.*)$', 1) AS query FROM p),
r AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{_TRACK}')), '&') AS kept,
  lower(regexp_extract(base, '^[A-Za-z]+://[^/]*', 0)) AS host, regexp_replace(base, '^[A-Za-z]+://[^/]*', '') AS path FROM q)
SELECT page_id, CASE WHEN NOT regexp_matches(url, '^[A-Za-z]+://') THEN url WHEN kept = '' THEN host || regexp_replace(path, '/$', '') ELSE host || path || '?' || kept END AS url FROM r""",
    "url_parts_decode": r"""
SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, url_decode(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS path,
  NOT ends_with(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '.example.com') AS is_foreign FROM pages""",
    "html_strip_text": f"SELECT page_id, {_collapse(_strip_tags('html'))} AS text FROM pages",
    "html_title_entities": rf"WITH t AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g') AS t FROM pages) SELECT page_id, {_collapse(_decode(_strip_tags('t')))} AS title FROM t",
    "html_links_array": """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages) SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS href FROM l""",
    "title_normalize": rf"SELECT doc_id, {_norm("regexp_extract(text, '^[^\n]*', 0)")} AS title FROM documents",
    "slug_hash": f"WITH {_H} SELECT doc_id, id, replace({_norm('title')}, ' ', '-') AS slug, substr(sha1(title || chr(0) || summary), 1, 16) AS cache_key FROM heads",
    "truncate_words": f"WITH t AS (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents) SELECT doc_id, {_truncate('t', 120)} AS short FROM t",
    "headline_projection": f'WITH {_H} SELECT doc_id, id, "column", source, title, summary, url, epoch(date)::BIGINT AS epoch FROM heads',
    "route_first_match": f"""WITH {_H} SELECT doc_id, CASE WHEN regexp_matches(title, '(?i)licensed|license') THEN 'legal' WHEN regexp_matches(title, '\\|') THEN 'lists' WHEN regexp_matches(title, '!!') THEN 'shout' WHEN length(title) BETWEEN 1 AND 20 THEN 'short' ELSE "column" END AS route FROM heads""",
    "filter_reasons": f"WITH {_H}, {_REASONS} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasons GROUP BY 1",
    "sponsored_refilter": f"""WITH {_H} SELECT "column", count(*) AS n FROM heads WHERE NOT ("column" = 'en' AND (regexp_matches({_BOTH}, '{_BLOCK}') OR regexp_matches({_BOTH}, '{_SPONSORED}'))) GROUP BY 1""",
    "dedup_greedy_dual_key": f"""
WITH RECURSIVE {_H},
r AS (SELECT doc_id, url, {_norm('title')} AS norm, row_number() OVER (ORDER BY doc_id) AS i FROM heads),
walk AS (
  SELECT 0::BIGINT AS i, []::VARCHAR[] AS a, []::VARCHAR[] AS b, NULL::BIGINT AS kept
  UNION ALL
  SELECT r.i, CASE WHEN ok THEN list_append(a, url) ELSE a END, CASE WHEN ok THEN list_append(b, norm) ELSE b END, CASE WHEN ok THEN doc_id END
  FROM (SELECT r.*, w.a, w.b, NOT list_contains(w.a, r.url) AND NOT list_contains(w.b, r.norm) AS ok FROM walk w JOIN r ON r.i = w.i + 1) r)
SELECT r.doc_id, r.url, r.norm FROM r JOIN walk w ON w.kept = r.doc_id""",
    "topk_two_level": f"""WITH {_H}, a AS (SELECT *, row_number() OVER (PARTITION BY "column", source ORDER BY date DESC, doc_id) AS r1 FROM heads),
b AS (SELECT "column", doc_id, row_number() OVER (PARTITION BY "column" ORDER BY date DESC, doc_id) AS rank FROM a WHERE r1 <= 7) SELECT "column", rank, doc_id FROM b WHERE rank <= 36""",
    "mode_tiebreak": """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS mode FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, list_position(['purchase','signup','click','view','error'], event_type)) = 1""",
    "title_case_sources": rf"""WITH {_H}, {_TOKENS}, f AS (SELECT source, regexp_matches(w, '^\p{{Lu}}') AS cap FROM toks WHERE i > 0 AND length(w) > 3 AND regexp_matches(w, '^\p{{L}}') AND lower(w) NOT IN ('the','is','it','der','la'))
SELECT source, count(*) AS words, count(*) FILTER (cap) AS caps, count(*) >= 12 AND count(*) FILTER (cap) / count(*) > 0.6 AS title_case FROM f GROUP BY source""",
    "proper_nouns": rf"""WITH {_H}, {_TOKENS},
d AS (SELECT *, regexp_matches(w, '^.+\p{{Lu}}') AS odd FROM toks),
u AS (SELECT *, regexp_matches(w, '^\p{{L}}.*[\p{{L}}\p{{N}}+]$') AND regexp_matches(w, '\p{{L}}.*\p{{L}}') AND lower(w) NOT IN ('the','is','it','der','la') AND (odd OR (i > 0 AND regexp_matches(w, '^\p{{Lu}}'))) AS usable FROM d),
c AS (SELECT *, (NOT usable)::INT + coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY i)::INT, 0) AS cut FROM u),
s AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c)
SELECT DISTINCT doc_id, array_to_string((list(w ORDER BY i))[1:3], ' ') AS term FROM s WHERE usable GROUP BY doc_id, run""",
    "term_match_theta": f"WITH {_H}, {_WATCH} SELECT term, count(*) AS n FROM heads JOIN terms ON regexp_matches(title, pattern) GROUP BY term",
    "trend_scores": f"""WITH {_H}, {_WATCH}, {_SCORED} SELECT term, count, sources, "column", tenths / 10.0::DOUBLE AS score, array_to_string(ids, ',') AS ids FROM scored""",
    "trend_suppressed": f"""WITH RECURSIVE {_H}, {_WATCH}, {_SCORED},
o AS (SELECT term, ids, tenths, row_number() OVER (ORDER BY tenths DESC, sources DESC, term) AS i FROM scored),
walk AS (
  SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept, NULL::VARCHAR AS term, NULL::HUGEINT AS tenths
  UNION ALL
  SELECT x.i, CASE WHEN ok THEN list_append(kept, x.term) ELSE kept END, CASE WHEN ok THEN x.term END, x.tenths::HUGEINT
  FROM (SELECT o.*, w.kept, len(w.kept) < 12 AND NOT EXISTS (SELECT 1 FROM o p WHERE list_contains(w.kept, p.term) AND len(list_intersect(p.ids, o.ids)) / least(len(p.ids), len(o.ids)) >= 0.8) AS ok FROM walk w JOIN o ON o.i = w.i + 1) x)
SELECT row_number() OVER (ORDER BY i) AS rank, term, (tenths / 10.0)::DOUBLE AS score FROM walk WHERE term IS NOT NULL""",
    "trend_mined": f"""WITH {_H}, {_MINED} SELECT term, count, sources, "column", tenths / 10.0::DOUBLE AS score FROM mined""",
    "trend_top": f"""WITH RECURSIVE {_H}, {_MINED},
o AS (SELECT term, ids, tenths, row_number() OVER (ORDER BY tenths DESC, sources DESC, place) AS i FROM mined),
walk AS (
  SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept, NULL::VARCHAR AS term, NULL::HUGEINT AS tenths
  UNION ALL
  SELECT x.i, CASE WHEN ok THEN list_append(kept, x.term) ELSE kept END, CASE WHEN ok THEN x.term END, x.tenths::HUGEINT
  FROM (SELECT o.*, w.kept, len(w.kept) < 12 AND NOT EXISTS (SELECT 1 FROM o p WHERE list_contains(w.kept, p.term) AND len(list_intersect(p.ids, o.ids)) / least(len(p.ids), len(o.ids)) >= 0.8) AS ok FROM walk w JOIN o ON o.i = w.i + 1) x)
SELECT row_number() OVER (ORDER BY i) AS rank, term, (tenths / 10.0)::DOUBLE AS score FROM walk WHERE term IS NOT NULL""",
    "item_heat": f"""WITH {_H}, {_WATCH}, {_SCORED}, x AS (SELECT unnest(ids) AS id, tenths FROM scored), y AS (SELECT id, sum(tenths) AS t FROM x GROUP BY id)
SELECT heads.id, (coalesce(t, 0) / 10.0)::DOUBLE AS heat FROM heads LEFT JOIN y ON heads.id = y.id""",
    "news_upsert_max": _UPSERT,
    "retention": f"SELECT event_type, count(*) AS n FROM events WHERE ts >= {_NOW} - INTERVAL 14 DAY GROUP BY 1",
    "weekly_candidates": f"""WITH t AS (SELECT event_id AS id, ts, value AS heat, event_type AS "column" FROM events WHERE ts >= {_NOW} - INTERVAL 7 DAY ORDER BY heat DESC, ts DESC, id LIMIT 400),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY heat DESC, ts DESC, id) AS rank FROM t) SELECT "column", rank, id, heat FROM r WHERE rank <= 4""",
    "iso_week_rollup": "SELECT strftime(ts, '%G-W%V') AS week, count(*) AS n, round(sum(value::DECIMAL(18,2))::DOUBLE, 2) AS total FROM events GROUP BY 1",
    "schedule_flags": """WITH l AS (SELECT isodow(ts - INTERVAL 3 HOUR) AS d, hour(ts - INTERVAL 3 HOUR) * 60 + minute(ts - INTERVAL 3 HOUR) AS m FROM events)
SELECT d > 5 OR (d = 5 AND m >= 405) AS draft_due, d > 5 OR (d = 5 AND m >= 540) AS send_due, count(*) AS n FROM l GROUP BY 1, 2""",
    "subscriber_validate": f"""WITH {_SUBS} SELECT c_custkey, array_to_string(list_filter([
  CASE WHEN length(name) > 0 AND (length(name) < 2 OR length(name) > 80 OR regexp_matches(name, '(?i)https?:|[<>@]')) THEN 'name' END,
  CASE WHEN NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]{{2,}}$') THEN 'email' END,
  CASE WHEN coalesce(phone, '') <> '' AND e164 IS NULL THEN 'phone' END,
  CASE WHEN NOT coalesce(consent, false) THEN 'consent' END], lambda x: x IS NOT NULL), ',') AS errors FROM phones""",
    "phone_e164": f"WITH {_SUBS} SELECT c_custkey, e164 AS phone FROM phones",
    "subscriber_upsert": """WITH l AS (SELECT 'u' || o_custkey AS email, o_orderkey AS seq, o_orderdate AS ts, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR END AS phone, o_orderstatus AS source FROM orders)
SELECT email, arg_max(name, seq) FILTER (name <> '') AS name, arg_max(phone, seq) FILTER (phone IS NOT NULL) AS phone, epoch(max(ts))::BIGINT AS consent_at, epoch(min(ts))::BIGINT AS created_at, arg_min(source, seq) AS source FROM l GROUP BY email""",
    "sync_stats": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders",
    "status_case": "SELECT CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'error' ELSE 'pending' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "csv_guard": r"""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '=' WHEN 1 THEN 'a"b;' ELSE '' END || text AS t FROM documents),
g AS (SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\-@\t\r]') THEN '''' || t ELSE t END AS t FROM r)
SELECT doc_id, CASE WHEN regexp_matches(t, '[";\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS cell FROM g""",
    "html_escape": """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe FROM pages""",
    "cache_lookup": f"WITH {_CACHE} SELECT d.doc_id, cached, CASE WHEN cached IS NULL THEN 'miss' WHEN cached = '' THEN 'known_missing' ELSE 'hit' END AS state FROM documents d LEFT JOIN cache c ON d.doc_id = c.doc_id",
    "cache_gc": f"WITH {_CACHE} SELECT doc_id, cached FROM cache WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "negative_cache": f"WITH {_CACHE} SELECT CASE WHEN cached IS NULL THEN 'miss' WHEN cached = '' THEN 'known_missing' ELSE 'hit' END AS state, count(*) AS n FROM documents d LEFT JOIN cache c ON d.doc_id = c.doc_id GROUP BY 1",
    "lexicon_language_check": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents),
c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the','of','and','in','that'))) AS en, len(list_filter(w, lambda x: x IN ('le','de','la','les','que'))) AS fr FROM w)
SELECT doc_id, en, fr, en >= 2 AND en > fr AS untranslated FROM c""",
    "batched_inference": f"WITH {_H} SELECT doc_id, upper({_norm('title')}) AS output FROM heads",
    "model_output_guard": "WITH p AS (SELECT doc_id % 60 AS item_id, min(doc_id) AS pos FROM documents GROUP BY 1) SELECT item_id, pos FROM p WHERE item_id IN (SELECT item_id FROM benchmark) ORDER BY pos, item_id LIMIT 8",
    "weekly_edition": """WITH p AS (SELECT doc_id % 60 AS item_id, min(doc_id) AS pos FROM documents GROUP BY 1),
g AS (SELECT item_id, pos FROM p WHERE item_id IN (SELECT item_id FROM benchmark) ORDER BY pos, item_id LIMIT 8),
f AS (SELECT item_id, row_number() OVER (ORDER BY length(text) DESC, item_id) AS pos FROM benchmark)
SELECT item_id, pos FROM g WHERE (SELECT count(*) FROM g) >= 3 UNION ALL SELECT item_id, pos FROM f WHERE pos <= 8 AND (SELECT count(*) FROM g) < 3""",
    "semi_live_columns": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "anti_pending": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "json_props": "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) FILTER ((props->>'$.k') IS NULL) AS broken FROM events GROUP BY 1",
    "json_coalesce": "SELECT event_id, CASE WHEN event_id % 4 <> 2 THEN (props->>'$.k')::BIGINT END AS k FROM events",
    "rate_limit_tumbling": _RATE,
    "ua_gate": """SELECT CASE WHEN event_type = 'error' THEN '405' WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN '403-agent' WHEN event_id % 23 = 0 THEN '403-frame' WHEN event_id % 19 = 0 THEN '302-referer' ELSE '200' END AS decision, count(*) AS n FROM events GROUP BY 1""",
    "edition_state_machine": """
WITH RECURSIVE e AS (SELECT user_id AS edition, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type AS t FROM events),
walk AS (
  SELECT DISTINCT edition, 0::BIGINT AS i, 'draft' AS status, 0::BIGINT AS changes FROM e
  UNION ALL
  SELECT w.edition, e.i, CASE WHEN status = 'draft' AND t = 'click' THEN 'sending' WHEN status = 'sending' AND t = 'view' THEN 'sent' WHEN status = 'sending' AND t = 'purchase' THEN 'draft' WHEN status = 'sending' AND t = 'signup' THEN 'scheduled' ELSE status END,
    changes + CASE WHEN (status = 'draft' AND t = 'click') OR (status = 'sending' AND t IN ('view', 'purchase', 'signup')) THEN 1 ELSE 0 END
  FROM walk w JOIN e ON e.edition = w.edition AND e.i = w.i + 1)
SELECT edition, arg_max(status, i) AS status, max(changes) AS changes FROM walk GROUP BY edition""",
    "date_parse_lenient": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN floor(epoch(ts))::BIGINT END AS epoch FROM events",
    "run_report": f"""WITH {_H}, {_REASONS} SELECT source, count(*) AS found, count(*) FILTER (reason IS NULL) AS used, count(*) FILTER (reason = 'blocked') AS blocked, count(*) FILTER (reason = 'noise') AS noise, count(*) FILTER (reason = 'old') AS old FROM reasons GROUP BY source""",
    "feed_parse": f"WITH {_H} SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ord, {_collapse(_decode('title'))} AS title, url FROM heads",
    "stream_upsert": _UPSERT,
    "stream_rate_limit": _RATE,
}
