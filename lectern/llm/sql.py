"""SQL twins of those queries that SQL can express (DuckDB dialect)."""

from __future__ import annotations

_SPACE = "[\\s\\x{0b}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"
_P2 = f"""
WITH kept AS (SELECT book_id, chunk_id, lower(regexp_replace(term, '^{_SPACE}|{_SPACE}$', '', 'g')) AS term, hit_count, indexed_at FROM postings),
live AS (SELECT book_id, chunk_id, term, hit_count FROM kept WHERE term <> '' AND hit_count >= 1
  QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id, term ORDER BY indexed_at DESC NULLS LAST, hit_count DESC) = 1),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT book_id, chunk_id FROM live)),
t AS (SELECT term, CAST(sum(hit_count) AS BIGINT) AS hits, count(*) AS records FROM live GROUP BY term),
v AS (SELECT term, hits, records, CASE WHEN hits < 3 THEN 'rare' WHEN records > 0.15 * n THEN 'common' END AS verdict FROM t, n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + "SELECT term, verdict FROM v WHERE verdict IS NOT NULL",
        "p2_term_counts": _P2 + "SELECT term, hits, records, verdict FROM v",
        "p6_found": "SELECT DISTINCT c.book_id, c.chunk_id FROM chunks c JOIN import_profiles p USING (import_profile) WHERE length(c.text) > p.max_chars",
    }
