"""DuckDB SQL of the plans in ``archive``."""

from headwater.plans.archive import GONE
from headwater.plans.ledger_oracles import LEDGER
from headwater.plans.oracles import _H

_ITEMS = f"""page AS (SELECT r."column", rank, substr(sha1(doc_id::VARCHAR), 1, 10) AS id, d.source, title, url FROM ({LEDGER["composed_run"]}) r JOIN documents d USING (doc_id))"""

ARCHIVE = {
    "nfc_titles": rf"""WITH {_H} SELECT doc_id, nfc_normalize(regexp_replace(title, '([aeiou])', '\1' || chr(769) || chr(803), 'g')) AS title FROM heads""",
    "snapshot_items": f"""WITH {_ITEMS} SELECT "column", rank, id, source, title, url FROM page WHERE "column" NOT IN {GONE}""",
    "snapshot_trends": f"""WITH {_ITEMS} SELECT t.rank, t.term, t.score, t."column", i.id FROM ({LEDGER["trend_report"]}) t JOIN ({LEDGER["trend_items"]}) i USING (rank, term)
WHERE t."column" NOT IN {GONE} AND i.id IN (SELECT id FROM page)""",
    "snapshot_names": f"""WITH {_ITEMS}, c AS (SELECT DISTINCT lang AS id FROM documents UNION SELECT unnest(['legal', 'lists', 'shout', 'short']))
SELECT 'columns' AS part, id, upper(id) AS name FROM c WHERE id NOT IN {GONE} UNION ALL SELECT DISTINCT 'sources', source, upper(source) FROM page""",
}
