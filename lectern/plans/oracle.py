"""The registered queries in SQL (DuckDB dialect), written independently of the Spark plans.

Folds over a text are list reductions here; compatibility forms of Unicode are a
translation table made by rule.  HTML to text needs a parser and has no SQL
twin; it is tested against goldens.
"""

from __future__ import annotations

import unicodedata

from lectern.functions.tokens import STOP_WORDS
from lectern.plans.queries import BOTH, HEADED, KEYWORDS, MISSED, PHRASE, SPOTS

_WS = "[\\s\\x{0b}\\x{85}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]".replace("\\x{85}", "")
_WORD = "[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?"
_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', {to}, 'g')"


def _trim(x: str) -> str:
    return _sub(x, f"^{_WS}+|{_WS}+$", "''")


def _clean(x: str) -> str:
    x = _sub(f"coalesce({x}, '')", "\\r\\n?", "chr(10)")
    x = _sub(x, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "''")
    x = _sub(x, "[ \\t]*\\n[ \\t]*", "chr(10)")
    x = _sub(x, "[ \\t]{2,}", "' '")
    return _trim(_sub(x, "\\n{3,}", "chr(10) || chr(10)"))


def _inline(x: str) -> str:
    return f"trim({_sub(f"coalesce({x}, '')", f'{_WS}+', "' '")}, ' ')"


def _title(x: str) -> str:
    return f"coalesce(nullif({_trim(f"regexp_replace(coalesce({x}, ''), '^#{{1,3}}\\s+', '')")}, ''), '片段')"


def _chapter(x: str) -> str:
    num = "[一二三四五六七八九十百千万零〇0-9]+"
    pats = ("^#{1,3}\\s+.+$", f"^第{num}[章节回篇卷部].*$", f"^{num}[、.．]\\s*.+$", "^(?i:Chapter)\\s+[0-9IVXLCDMivxlcdm]+(?:\\s*[:：]\\s*.+|\\s+.+)?$")
    hit = " OR ".join(f"regexp_matches({x}, '{p}')" for p in pats)
    return f"(length({x}) BETWEEN 2 AND 80 AND NOT regexp_matches({x}, '[。；;]') AND ({hit}))"


_CHUNKS = "chunks_live AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
_LARGEST = "(SELECT book_id FROM chunks_live WHERE book_id IS NOT NULL GROUP BY book_id ORDER BY count(*) DESC, book_id LIMIT 1)"
_BOOKS = "books_live AS (SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY imported_at DESC NULLS LAST) = 1)"


def _terms(chunks: str = "chunks_live") -> str:
    """CTEs: every term occurrence, counts, pruned counts, postings."""
    return f"""
src AS (SELECT book_id, chunk_id, {_clean("text")} AS t FROM {chunks} WHERE text IS NOT NULL),
runs AS (SELECT book_id, chunk_id, unnest(regexp_extract_all(t, '\\p{{Han}}+')) AS r FROM src),
occ AS (SELECT book_id, chunk_id, lower(unnest(regexp_extract_all(t, '{_WORD}'))) AS term FROM src
  UNION ALL SELECT book_id, chunk_id, substring(r, i, 2) FROM (SELECT book_id, chunk_id, r, unnest(range(1, length(r))) AS i FROM runs)),
counts AS (SELECT book_id, chunk_id, term, count(*) AS count FROM occ WHERE length(term) BETWEEN 2 AND 30 AND term NOT IN {_STOP} GROUP BY ALL),
size AS (SELECT book_id, count(DISTINCT chunk_id) AS n FROM {chunks} GROUP BY book_id),
stats AS (SELECT book_id, term, sum(count) AS total, count(*) AS df FROM counts GROUP BY ALL),
kept AS (SELECT c.* FROM counts c JOIN stats s USING (book_id, term) JOIN size z USING (book_id) WHERE s.total >= 2 AND s.df <= greatest(1, floor(z.n * 0.6))),
posts AS (SELECT book_id, term, chunk_id, count, row_number() OVER (PARTITION BY book_id, term ORDER BY count DESC, chunk_id) AS rank FROM kept QUALIFY rank <= 50),
words AS (SELECT book_id, chunk_id, term, count, row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY count DESC, term) AS n FROM kept)"""


def _query(text: str) -> str:
    """CTE ``tok(pos, token, weight)`` and ``q`` of one query text."""
    return f"""
qt AS (SELECT '{text}' AS q),
tw AS (SELECT 0 AS g, i AS a, 0 AS b, lower(w) AS token FROM (SELECT unnest(regexp_extract_all(q, '{_WORD}')) AS w, generate_subscripts(regexp_extract_all(q, '{_WORD}'), 1) AS i FROM qt)),
tr AS (SELECT unnest(regexp_extract_all(q, '\\p{{Han}}+')) AS r, generate_subscripts(regexp_extract_all(q, '\\p{{Han}}+'), 1) AS a FROM qt),
th AS (SELECT 1 AS g, a, 0 AS b, r AS token FROM tr WHERE length(r) BETWEEN 2 AND 3 UNION ALL SELECT 1, a, i, substring(r, i, 2) FROM (SELECT r, a, unnest(range(1, length(r))) AS i FROM tr)),
tall AS (SELECT token, min((g, a, b)) AS o FROM (SELECT * FROM tw UNION ALL SELECT * FROM th) WHERE token NOT IN {_STOP} GROUP BY token),
tok AS (SELECT row_number() OVER (ORDER BY o) - 1 AS pos, token, CASE WHEN regexp_matches(token, '[A-Za-z]') OR length(token) >= 3 THEN 2 ELSE 1 END AS weight
  FROM (SELECT * FROM tall UNION ALL SELECT q, NULL FROM qt WHERE NOT EXISTS (SELECT * FROM tall)))"""


def _preview(body: str, query: str, matched: str, most: int) -> str:
    src, q = _inline(body), _inline(query)
    pos = f"(CASE WHEN {q} = '' THEN 1 WHEN instr({src}, {q}) > 0 THEN instr({src}, {q}) ELSE coalesce(list_filter(list_transform({matched}, lambda t: instr({src}, t)), lambda p: p > 0)[1], 0) END)"
    start = f"greatest(0, {pos} - 1 - {most // 2})"
    cut = f"(CASE WHEN {start} > 0 THEN '……' ELSE '' END || substring({src}, {start} + 1, {most}) || CASE WHEN least(length({src}), {start} + {most}) < length({src}) THEN '……' ELSE '' END)"
    return f"CASE WHEN {src} = '' THEN '' WHEN {pos} > 0 THEN {cut} ELSE substring({src}, 1, {most}) END"


def _keyword(text: str, limit: int = 10, chunks: str = "chunks_live", first: str = "") -> str:
    rank = "ORDER BY score DESC, len(matched) DESC, ord, book_id, chunk_id"
    return f"""WITH {_CHUNKS}{first}, {_terms(chunks)}, {_query(text)},
hits AS (SELECT p.book_id, p.chunk_id, sum(p.count * t.weight) AS score, list(t.token ORDER BY t.pos) AS matched FROM posts p JOIN tok t ON p.term = t.token GROUP BY ALL),
pre AS (SELECT h.*, c.ord, c.text AS body FROM hits h JOIN {chunks} c USING (book_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY h.book_id {rank}) <= {max(5 * limit, 20)}),
boosted AS (SELECT book_id, chunk_id, ord, score + CASE WHEN contains({_clean("body")}, q) THEN 4 ELSE 0 END AS score, matched, body FROM pre, qt),
scan AS (SELECT book_id, chunk_id, ord, {_clean("text")} AS body FROM {chunks} WHERE book_id IN (SELECT book_id FROM posts) AND book_id NOT IN (SELECT book_id FROM hits)),
have AS (SELECT s.book_id, s.chunk_id, s.ord, s.body, qt.q, coalesce(sum(t.weight), 0) AS w, list(t.token ORDER BY t.pos) FILTER (t.token IS NOT NULL) AS m FROM scan s CROSS JOIN qt LEFT JOIN tok t ON contains(s.body, t.token) GROUP BY ALL),
missed AS (SELECT book_id, chunk_id, ord, w + CASE WHEN contains(body, q) THEN 4 ELSE 0 END AS score, coalesce(m, [q]) AS matched, body FROM have WHERE w > 0 OR contains(body, q)),
per AS (SELECT * FROM (SELECT * FROM boosted UNION ALL SELECT * FROM missed) QUALIFY row_number() OVER (PARTITION BY book_id {rank}) <= {limit}),
best AS (SELECT * FROM per QUALIFY row_number() OVER ({rank}) <= {limit})
SELECT book_id, chunk_id, CAST(ord AS BIGINT) AS ord, CAST(score AS BIGINT) AS score, array_to_string(matched, '|') AS matched, {_preview("body", "q", "matched", 220)} AS preview FROM best, qt"""


def _exact(where: str, one_book: bool) -> str:
    cut = "" if one_book else "QUALIFY row_number() OVER (ORDER BY score DESC, ord, book_id, chunk_id) <= 10"
    return f"""WITH {_CHUNKS}, qt AS (SELECT '{PHRASE}' AS q),
b AS (SELECT book_id, chunk_id, ord, {_inline("text")} AS body FROM chunks_live WHERE text IS NOT NULL {where}),
h AS (SELECT b.*, q, 100 + 5 * ((length(body) - length(replace(body, q, ''))) // length(q)) AS score FROM b, qt WHERE contains(body, q)),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY ord, chunk_id) <= 10),
r AS (SELECT * FROM f {cut})
SELECT book_id, chunk_id, CAST(ord AS BIGINT) AS ord, CAST(score AS BIGINT) AS score, {_preview("body", "q", "[q]", 220)} AS preview FROM r"""


_PROGRESS = f"""progress AS (SELECT book_id,
  {", ".join(f"arg_max({c}, (lr, rc, update_id)) FILTER ({c} IS NOT NULL AND {c} <> '') AS {c}" for c in ("last_chunk_id", "next_chunk_id", "status", "note_path"))},
  coalesce(arg_max(th, (lr, rc, update_id)) FILTER (th IS NOT NULL), []) AS current_themes,
  max(last_read_at) AS last_read_at, arg_max(update_id, (lr, rc, update_id)) AS recency_seq
  FROM (SELECT book_id, last_chunk_id, next_chunk_id, status, note_path, update_id, coalesce(last_read_at, TIMESTAMP '0001-01-01') AS lr, coalesce(received_at, TIMESTAMP '0001-01-01') AS rc, last_read_at, list_filter(list_transform(current_themes, lambda x: {_trim("x")}), lambda x: x IS NOT NULL AND x <> '') AS th FROM progress_updates WHERE book_id IS NOT NULL)
  GROUP BY book_id)"""


def _nfkc(x: str) -> str:
    """Compatibility form: characters with a form of one character each, then composed."""
    made = {c: k for c in map(chr, range(0xA0, 0x10000)) if (k := unicodedata.normalize("NFKC", c)) != c and len(k) == 1}
    return f"nfc_normalize(translate({x}, '{"".join(made)}', '{"".join(made.values()).replace("'", "''")}'))"


_OTHER = f"[^{''.join(chr(a) + ('-' + chr(b) if b != a else '') for a, b in ((0x2E80, 0x2FFF), (0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)))}A-Za-z0-9]+"


def _title_key(x: str) -> str:
    v = _sub(_nfkc(f"coalesce({x}, '')"), "[《》]", "' '")
    v = _sub(v, "(?i)\\.(epub|txt|md)\\b", "' '")
    v = _sub(v, "(?i)\\b(epub|txt|md)\\b", "' '")
    v = _sub(v, "\\b(全集|完本|校对版|校對版|出版版|番外|精校版|精修版|实体书版|實體書版)\\b", "' '")
    v = _sub(v, "(?i)[\\[(（【][\\s]*((无限|完本|全集|校对版|校對版|出版版|epub|txt|md|番外|精校版|精修版)\\s*)*[\\])）】]", "' '")
    v = _sub(v, "[\\[(（【]([^\\])）】]{0,30})[\\])）】]", "'\\1'")
    return f"lower({_sub(_sub(v, '作者[:：]', chr(39) + ' ' + chr(39)), _OTHER, chr(39) * 2)})"


def _author_key(x: str) -> str:
    return f"lower({_sub(_sub(_nfkc(f'coalesce({x}, {chr(39) * 2})'), '作者[:：]', chr(39) + ' ' + chr(39)), _OTHER, chr(39) * 2)})"


def _safe_id(x: str) -> str:
    ws = _WS.replace("\\x{feff}", "")  # no space here
    v = f"lower({_sub(_nfkc(f"coalesce(nullif({x}, ''), 'untitled')"), f'^{ws}+|{ws}+$', "''")})"
    v = _sub(_sub(v, '[<>:"/\\\\|?*\\x00-\\x1F]', "' '"), f"(_|{ws})+", "'-'")
    return _sub(_sub(_sub(v, "[^\\p{L}\\p{N}-]", "''"), "-+", "'-'"), "^-|-$", "''")


_EXTERNAL = f"""ext AS (SELECT entry_id AS ext_id, {_title_key("weread_title")} AS et, {_author_key("weread_author")} AS ea FROM (SELECT * FROM book_map
  QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY received_at DESC NULLS LAST, weread_title DESC NULLS LAST, weread_author DESC NULLS LAST) = 1)),
loc AS (SELECT book_id, title, {_title_key("title")} AS bt, {_author_key("author")} AS ba, {_title_key("book_id")} AS bi FROM books_live),
scored AS (SELECT ext_id, book_id, title, et, round(least(0.99, base + CASE WHEN same THEN 0.08 ELSE 0 END + CASE WHEN own THEN 0.05 ELSE 0 END), 2)::DOUBLE AS score,
  concat_ws('|', CASE base WHEN 0.9 THEN 'normalizedTitle' WHEN 0.75 THEN 'titleIncludes' END, CASE WHEN same THEN 'normalizedAuthor' END, CASE WHEN own THEN 'localBookId' END) AS matched_by
  FROM (SELECT *, CASE WHEN et = bt THEN 0.9 WHEN bt <> '' AND (contains(et, bt) OR contains(bt, et)) THEN 0.75 ELSE 0.0 END AS base, ea <> '' AND ea = ba AS same, et = bi AS own FROM ext, loc WHERE et <> '')
  WHERE base > 0 OR own)"""


def _value(x: str) -> str:
    """A metadata value: trimmed, outer quotes removed; null if empty or too long."""
    v = _sub(_sub(_trim(x), "^[\"''“‘《]+", "''"), "[\"''”’》]+$", "''")
    return f"(CASE WHEN length({_trim(v)}) BETWEEN 1 AND 120 THEN {_trim(v)} END)"


def _metadata(src: str) -> str:
    """CTEs over ``src(id, text, path)``: ``meta(id, title, author)``."""

    def first(lines: str, *patterns: str, keep: str = "true") -> str:
        found = "coalesce(" + ", ".join(f"nullif(regexp_extract(x, '{p}', 1), '')" for p in patterns) + ", '')"
        return f"list_filter(list_transform({lines}, lambda x: {_value(found)}), lambda v: v IS NOT NULL AND {keep})[1]"

    stem = "regexp_replace(regexp_extract(replace(coalesce(path, ''), chr(92), '/'), '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
    ok = f"length(v) <= 80 AND NOT {_chapter('v')} AND NOT regexp_matches(v, '^(第[一二三四五六七八九十百千万零〇0-9]+[章节回篇卷部]|(?i:Chapter)\\s+)')"
    return f"""ml AS (SELECT id, path, list_transform(string_split({_clean('text')}, chr(10))[1:30], lambda x: {_trim('x')}) AS l FROM {src}),
mf AS (SELECT id, path, l, CASE WHEN l[1] = '---' AND list_position(l[2:30], '---') > 1 THEN l[2:list_position(l[2:30], '---')] ELSE [] END AS f FROM ml),
meta AS (SELECT id, coalesce({first("f", "(?i)^title\\s*:\\s*(.+)$")}, {first("l", "^(?:书名|标题)\\s*[:：]\\s*(.+)$", "(?i)^Title\\s*:\\s*(.+)$")}, {stem}) AS title,
  coalesce({first("f", "(?i)^author\\s*:\\s*(.+)$")}, {first("l", "^(?:作者|著者)\\s*[:：]\\s*(.+)$", "(?i)^Author\\s*:\\s*(.+)$", "(?i)^By\\s+(.+)$", keep=ok)}) AS author FROM mf)"""


def _without_front_matter(x: str) -> str:
    at = f"list_position(list_transform(string_split({x}, chr(10))[2:50], lambda y: {_trim('y')}), '---')"
    return f"CASE WHEN {_trim(f'string_split({x}, chr(10))[1]')} = '---' AND {at} > 0 THEN {_clean(f'array_to_string(string_split({x}, chr(10))[{at} + 2:], chr(10))')} ELSE {x} END"


def _segments(most: int = 1000, least: int = 350) -> str:
    """CTEs: the chunks of every document, ``made(book_id, parts)``, as folds over lists."""
    tiny = max(120, least // 2)
    nl = "chr(10) || chr(10)"
    window = f"list_filter(list_transform(range(0, length(p), {most}), lambda k: {_trim(f'substring(p, k + 1, {most})')}), lambda w: w <> '')"
    none = "CAST([] AS STRUCT(t VARCHAR, open BOOLEAN)[])"

    def pack(items: str, glue: str) -> str:
        held = f"len(acc) > 0 AND acc[-1].open AND x[1].open AND length(acc[-1].t) + length({glue}) + length(x[1].t) <= {most}"
        return f"list_reduce({items}, lambda acc, x: CASE WHEN {held} THEN list_concat(acc[:-2], [{{'t': acc[-1].t || {glue} || x[1].t, 'open': true}}]) ELSE list_concat(acc, x) END, {none})"

    closed = f"list_transform({window}, lambda w: {{'t': w, 'open': false}})"
    each = f"CASE WHEN length(p) <= {most} THEN [{{'t': p, 'open': true}}] ELSE {closed} END"
    sentences = f"list_filter(list_transform(string_split({_sub('q', '([。！？!?；;])', "'\\1' || chr(1)")}, chr(1)), lambda y: {_trim('y')}), lambda y: y <> '')"
    by_sentence = f"CASE WHEN len({sentences}) > 1 THEN list_transform({pack(f'list_transform({sentences}, lambda p: {each})', "''")}, lambda z: {{'t': z.t, 'open': false}}) ELSE {closed.replace('(p', '(q').replace('length(p)', 'length(q)')} END"
    paragraphs = f"list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda y: {_trim('y')}), lambda y: y <> '')"
    headed = lambda x: _clean(f"'## ' || {x}.title || {nl} || {x}.body")
    joined = lambda a, b: _clean(f"{a} || {nl} || {headed(b)}")
    row = "STRUCT(title VARCHAR, section VARCHAR, body VARCHAR, carry BOOLEAN)[]"
    pack_row = lambda x, carry, title=None, section=None, body=None: f"{{'title': {title or x + '.title'}, 'section': {section or x + '.section'}, 'body': {body or x + '.body'}, 'carry': {carry}}}"
    # first the pending chunk is joined to the next one or put down, then the next one is looked at
    ahead = f"CASE WHEN len(acc) > 0 AND acc[-1].carry THEN CASE WHEN length({joined('acc[-1].body', 'x[1]')}) <= {most} THEN {{'a': acc[:-2], 'x': {pack_row('x[1]', 'false', 'acc[-1].title', 'acc[-1].section', joined('acc[-1].body', 'x[1]'))}}} ELSE {{'a': list_concat(acc[:-2], [{pack_row('acc[-1]', 'false')}]), 'x': x[1]}} END ELSE {{'a': acc, 'x': x[1]}} END"
    behind = f"CASE WHEN length(s.x.body) >= {tiny} THEN list_concat(s.a, [s.x]) WHEN len(s.a) > 0 AND length({joined('s.a[-1].body', 's.x')}) <= {most} THEN list_concat(s.a[:-2], [{pack_row('s.a[-1]', 'false', body=joined('s.a[-1].body', 's.x'))}]) ELSE list_concat(s.a, [{pack_row('s.x', 'true')}]) END"
    return f"""sl AS (SELECT doc_id, string_split({_clean('text')}, chr(10)) AS a FROM documents),
sx AS (SELECT doc_id, {_trim('line')} AS trimmed, line, pos FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM sl)),
sy AS (SELECT *, {_chapter('trimmed')} AS head, sum(CASE WHEN {_chapter('trimmed')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM sx),
sz AS (SELECT doc_id, sec, coalesce(max({_title('trimmed')}) FILTER (head), '片段 1') AS title, {_clean("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '')")} AS text FROM sy GROUP BY ALL),
ss AS (SELECT doc_id, list([{{'title': title, 'text': text}}] ORDER BY sec) AS secs FROM sz WHERE text <> '' GROUP BY doc_id),
sm AS (SELECT doc_id, list_reduce(secs, lambda acc, x: CASE WHEN length(acc[-1].text) < {least} AND length(acc[-1].text) + length('## ' || x[1].title || {nl} || x[1].text) + 2 <= {most}
  THEN list_concat(acc[:-2], [{{'title': acc[-1].title, 'text': {_clean(f"acc[-1].text || {nl} || '## ' || x[1].title || {nl} || x[1].text")}}}]) ELSE list_concat(acc, x) END) AS merged FROM ss),
su AS (SELECT doc_id, i, m.title AS title, m.text AS text FROM (SELECT doc_id, unnest(merged) AS m, generate_subscripts(merged, 1) AS i FROM sm)),
sp AS (SELECT doc_id, i, title, CASE WHEN length(text) <= {most} THEN [text] ELSE list_transform({pack(f"list_transform({paragraphs}, lambda q: CASE WHEN length(q) <= {most} THEN [{{'t': q, 'open': true}}] ELSE {by_sentence} END)", nl)}, lambda z: z.t) END AS pieces FROM su),
sf AS (SELECT doc_id, i, n, title AS section, CASE WHEN len(pieces) > 1 THEN title || ' Part ' || n ELSE title END AS title, {_clean('piece')} AS body FROM (SELECT doc_id, i, title, pieces, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS n FROM sp)),
sg AS (SELECT doc_id, count(*) AS initial, list([{{'title': title, 'section': section, 'body': body, 'carry': false}}] ORDER BY i, n) AS parts FROM sf GROUP BY doc_id),
made AS (SELECT CAST(doc_id AS VARCHAR) AS book_id, initial, list_reduce(parts, lambda acc, x: list_transform([{ahead}], lambda s: {behind})[1], CAST([] AS {row})) AS parts FROM sg)"""


_SKELETONS = f"""{_BOOKS}, b AS (SELECT book_id, coalesce(nullif(title, ''), book_id) AS t, coalesce(author, '') AS a FROM books_live), n AS (SELECT chr(10) AS n),
skeletons AS (SELECT book_id, h.heading, CAST(h.ordinal AS BIGINT) AS ordinal, CASE h.ordinal WHEN 0 THEN '- localBookId: ' || book_id || n || '- localTitle: ' || t || n || '- wereadTitle: ' || n || '- author: ' || a || n || '- lastChunkId: ' || n || '- nextChunkId: ' || n || '- lastPath: ' || n || '- nextPath: ' || n || '- lastSectionTitle: ' || n || '- lastReadAt: ' || n || '- noteUpdatedAt: ' || n || '- currentThemes: ' || n || '- currentMode: ' WHEN 1 THEN '暂无。' WHEN 2 THEN '暂无。' ELSE '' END AS content
FROM b, n, (VALUES ('阅读恢复区', 0), ('当前理解', 1), ('下次入口', 2), ('摘录与想法', 3), ('段落共读记录', 4), ('交叉关联', 5)) h(heading, ordinal))"""
_NOTES = f"""{_SKELETONS}, {_PROGRESS},
fresh AS (SELECT book_id, '当前理解' AS heading, coalesce(status, '') AS content FROM progress WHERE book_id IN (SELECT book_id FROM books_live)
  UNION ALL SELECT book_id, 'theme ' || t, t FROM (SELECT book_id, unnest(list_distinct(current_themes)) AS t FROM progress WHERE book_id IN (SELECT book_id FROM books_live))),
notes AS (SELECT s.book_id, s.heading, s.ordinal, coalesce(f.content, s.content) AS content FROM skeletons s LEFT JOIN fresh f ON s.book_id = f.book_id AND s.heading = f.heading
  UNION ALL SELECT book_id, heading, 5 + row_number() OVER (PARTITION BY book_id ORDER BY heading), content FROM fresh WHERE heading LIKE 'theme %')"""


def oracle_sql() -> dict[str, str]:
    with_terms = f"WITH {_CHUNKS}, {_terms()}"
    score = " + ".join(f"{w} * (length(t) - length(regexp_replace(t, '{p}', '', 'g')))" for p, w in (("\\x{fffd}", 30), ("\\x{0000}", 20), ("[\\x{01}-\\x{08}\\x{0b}\\x{0c}\\x{0e}-\\x{1f}]", 10), ("[锟斤拷ÃÂÐÑÊÖÎ]", 2)))
    out = {
        "clean_text": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
        "inline_preview": f"SELECT doc_id, substring({_inline('text')}, 1, 120) AS preview, substring({_inline('text')}, 1, 160) AS long_preview FROM documents",
        "count_words": f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) + len(regexp_extract_all(coalesce(text, ''), '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}]')) AS BIGINT) AS words FROM documents",
        "content_hash": f"WITH {_CHUNKS} SELECT book_id, chunk_id, sha256(coalesce(text, '')) AS chunk_hash FROM chunks_live",
        "misdecode_score": f"WITH {_CHUNKS}, s AS (SELECT book_id, chunk_id, coalesce(text, '') AS t FROM chunks_live), x AS (SELECT book_id, chunk_id, CASE WHEN t = '' THEN 1000 ELSE {score} END AS score FROM s) SELECT book_id, chunk_id, CAST(score AS BIGINT) AS score, score >= 20 AS misdecoded FROM x",
        "chapter_titles": f"WITH {_CHUNKS}, l AS (SELECT book_id, chunk_id, string_split({_clean('text')}, chr(10)) AS a FROM chunks_live), x AS (SELECT book_id, chunk_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS line_no FROM l) SELECT book_id, chunk_id, CAST(line_no AS BIGINT) AS line_no, line, {_title('line')} AS title FROM x WHERE {_chapter('line')}",
        "truncated_text": "SELECT doc_id, substring(coalesce(text, ''), 1, 400) AS text, length(coalesce(text, '')) > 400 AS truncated FROM documents",
        "file_stems": f"WITH {_BOOKS} SELECT book_id, regexp_replace(regexp_extract(replace(coalesce(source_path, ''), chr(92), '/'), '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM books_live",
        "html_headings": f"WITH {_CHUNKS} SELECT book_id, chunk_id, {_clean("regexp_replace(regexp_extract(text, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), '<[^>]*>', '', 'g')")} AS heading FROM chunks_live",
        "skippable_names": f"WITH {_CHUNKS}, s AS (SELECT book_id, chunk_id, lower(replace(coalesce(title, ''), ' ', '-')) AS t FROM chunks_live) SELECT book_id, chunk_id, regexp_matches(t, '目录|封面|版权') OR regexp_matches(t, '^(cover|nav|toc|titlepage|copyright|contents)[-_]?[0-9]*$') OR regexp_matches(t, '(^|[-_])(cover|nav|toc|titlepage|copyright|contents)([-_]|$)') AS skipped FROM s",
        "split_sections": f"""WITH {_CHUNKS}, l AS (SELECT book_id, chunk_id, string_split({_clean('text')}, chr(10)) AS a FROM chunks_live),
x AS (SELECT book_id, chunk_id, {_trim('line')} AS trimmed, line, pos FROM (SELECT book_id, chunk_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM l)),
y AS (SELECT *, {_chapter('trimmed')} AS head, sum(CASE WHEN {_chapter('trimmed')} THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, chunk_id ORDER BY pos) AS sec FROM x),
z AS (SELECT book_id, chunk_id, sec, coalesce(max({_title('trimmed')}) FILTER (head), '片段 1') AS title, {_clean("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '')")} AS text FROM y GROUP BY ALL)
SELECT book_id, chunk_id, row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY sec) - 1 AS section_no, title, text FROM z WHERE text <> ''""",
        "sentence_split": f"""WITH s AS (SELECT doc_id, string_split({_sub(_clean('text'), f'([。！？!?；;]){_WS}*', "'\\1' || chr(1)")}, chr(1)) AS a FROM documents),
x AS (SELECT doc_id, {_trim('p')} AS part, i FROM (SELECT doc_id, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM s))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, part FROM x WHERE part <> ''""",
        "hard_split": f"""WITH s AS (SELECT doc_id, {_clean('text')} AS t FROM documents), w AS (SELECT doc_id, t, unnest(range(0, length(t), 300)) AS k FROM s),
x AS (SELECT doc_id, k, {_trim('substring(t, k + 1, 300)')} AS part FROM w) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n, part FROM x WHERE part <> ''""",
        "segment_documents": f"""WITH {_segments()}, c AS (SELECT book_id, initial, len(parts) AS n, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS ord FROM made), d AS (SELECT *, 'ch' || lpad(CAST(ord AS VARCHAR), CAST(greatest(3, length(CAST(ord AS VARCHAR))) AS INTEGER), '0') AS cid FROM c)
SELECT book_id, cid AS chunk_id, p.title AS title, p.section AS section_title, CAST(ord AS INTEGER) AS ord, p.body AS text, CAST(length(p.body) AS INTEGER) AS char_count, CAST(len(regexp_extract_all(p.body, '{_WORD}')) + len(regexp_extract_all(p.body, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}]')) AS INTEGER) AS word_count,
  substring({_inline('p.body')}, 1, 120) AS preview, sha256(p.body) AS chunk_hash, lag(cid) OVER w AS prev_id, lead(cid) OVER w AS next_id, CAST(initial AS INTEGER) AS initial_chunks FROM d WINDOW w AS (PARTITION BY book_id ORDER BY ord)""",
        "document_metadata": f"WITH src AS (SELECT doc_id AS id, text, book_id AS path FROM documents), {_metadata('src')} SELECT id AS doc_id, title, author FROM meta",
        "header_metadata": f"WITH {_BOOKS}, src AS (SELECT book_id AS id, source_path AS path, {HEADED} AS text FROM books_live), {_metadata('src')} SELECT id AS book_id, meta.title, meta.author, {_without_front_matter('t')} AS body FROM meta JOIN (SELECT id, {_clean('text')} AS t FROM src) USING (id)",
        "front_matter_stripped": f"WITH s AS (SELECT doc_id, {_clean('text')} AS t FROM documents) SELECT doc_id, {_without_front_matter('t')} AS body FROM s",
        "safe_book_ids": f"WITH {_BOOKS} SELECT book_id, {_safe_id('title')} AS safe_id, {_title_key('title')} AS title_key, {_author_key('author')} AS author_key FROM books_live",
        "link_scores": f"WITH {_BOOKS}, {_EXTERNAL} SELECT ext_id, book_id, score, matched_by FROM scored",
        "link_decisions": f"""WITH {_BOOKS}, {_EXTERNAL}, top AS (SELECT *, row_number() OVER (PARTITION BY ext_id ORDER BY score DESC, title, book_id) AS n FROM scored),
p AS (SELECT ext_id, max(length(et)) AS len, max(score) FILTER (n = 1) AS score, max(book_id) FILTER (n = 1) AS book_id, count(*) FILTER (n <= 5) AS c FROM top GROUP BY ext_id),
a AS (SELECT *, CASE WHEN score >= CASE WHEN len <= 2 THEN 0.93 ELSE 0.88 END THEN 'linked' WHEN score >= 0.65 THEN 'pending' ELSE 'no-match' END AS action FROM p)
SELECT ext_id, action, CASE WHEN action = 'linked' THEN book_id END AS book_id, score, CAST(CASE WHEN action = 'pending' THEN c END AS INTEGER) AS candidates FROM a""",
        "link_keys": f"SELECT entry_id, CASE WHEN trim(coalesce(weread_book_id, ''), ' ') <> '' THEN 'id:' || trim(weread_book_id, ' ') ELSE 'title:' || {_title_key('weread_title')} || '::author:' || {_author_key('weread_author')} END AS link_key FROM (SELECT DISTINCT entry_id, weread_book_id, weread_title, weread_author FROM book_map)",
        "epub_sections": f"""WITH t AS (SELECT doc_id, doc_kind, source, {_inline('text')} AS body FROM documents WHERE text <> '')
SELECT 'doc-' || doc_id || '.epub' AS path, 'Doc ' || doc_id AS title, nullif(source, '') AS author, n AS section_no, CASE n WHEN 0 THEN coalesce(nullif(doc_kind, ''), 'c1') ELSE 'part2' END AS section_title, CASE n WHEN 0 THEN {_clean("coalesce(doc_kind, '') || chr(10) || chr(10) || body")} ELSE '* a' END AS text, CAST(NULL AS VARCHAR) AS error FROM t, (VALUES (CAST(0 AS BIGINT)), (1)) c(n)""",
        "html_like": "SELECT DISTINCT doc_kind, media, CASE WHEN media IS NULL OR media = '' THEN true WHEN media = 'image/svg+xml' THEN coalesce(contains(doc_kind, 'text/html'), true) ELSE true END AS html FROM documents, (VALUES ('text/HTML; charset=utf-8'), ('application/xhtml+xml'), ('image/svg+xml'), (''), (NULL)) m(media)",
        "safe_file_names": f"SELECT DISTINCT book_id, title || '?:\"a<b>|*. .' AS title, {_sub(_sub("title || '?:\"a<b>|*. .'", '[<>:\"/\\\\|?*\\x00-\\x1F]', "'_'"), '[. ]+$', "''")} AS name, {_value("' “《' || title || '?:\"a<b>|*. .' || '》” '")} AS value FROM books",
        "note_upserts": f"WITH {_NOTES} SELECT book_id, heading, ordinal, content FROM notes",
        "note_documents": f"""WITH {_NOTES}, m AS (SELECT n.book_id, '# ' || coalesce(nullif(any_value(b.title), ''), n.book_id) || chr(10) || chr(10) || string_agg('## ' || heading || CASE WHEN content <> '' THEN chr(10) || chr(10) || content ELSE '' END, chr(10) || chr(10) ORDER BY ordinal) || chr(10) AS t FROM notes n JOIN books_live b USING (book_id) GROUP BY n.book_id)
SELECT book_id, substring(t, 1, 400) AS text, length(t) > 400 AS truncated FROM m""",
        "link_resolved": f"""WITH {_BOOKS}, f AS (SELECT DISTINCT weread_book_id AS ext_id, weread_title AS ext_title, book_id FROM book_map JOIN books_live ON weread_title = title WHERE weread_book_id IS NOT NULL),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ext_id ORDER BY book_id, ext_title) = 1), w AS (SELECT DISTINCT weread_book_id AS ext_id, weread_title AS title FROM book_map),
i AS (SELECT ext_id, min(book_id) AS b1 FROM l GROUP BY ext_id), t AS (SELECT ext_title AS title, min(book_id) AS b2 FROM l GROUP BY ext_title),
pi AS (SELECT DISTINCT weread_book_id AS ext_id, true AS p1 FROM book_map WHERE status = 'pending'), pt AS (SELECT DISTINCT weread_title AS title, true AS p2 FROM book_map WHERE status = 'pending')
SELECT ext_id, title, coalesce(b1, b2) AS book_id, CASE WHEN coalesce(b1, b2) IS NOT NULL THEN 'linked' WHEN coalesce(p1, p2) THEN 'pending' ELSE 'unknown' END AS mapping FROM w LEFT JOIN i USING (ext_id) LEFT JOIN t USING (title) LEFT JOIN pi USING (ext_id) LEFT JOIN pt USING (title)""",
        "link_open": f"""WITH {_BOOKS}, k AS (SELECT DISTINCT entry_id, weread_title, CASE WHEN trim(coalesce(weread_book_id, ''), ' ') <> '' THEN 'id:' || trim(weread_book_id, ' ') ELSE 'title:' || {_title_key('weread_title')} || '::author:' || {_author_key('weread_author')} END AS key FROM book_map)
SELECT DISTINCT entry_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE weread_title IN (SELECT title FROM books_live))""",
        "decoded_texts": "SELECT doc_id, codec, CASE WHEN codec <> 'UTF-8' AND length(text) = 0 THEN '' ELSE text END AS decoded FROM documents, (VALUES ('UTF-8'), ('UTF-8-BOM'), ('UTF-16LE-BOM')) c(codec) WHERE text IS NOT NULL",
        "chunk_links": f"WITH {_CHUNKS} SELECT book_id, chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM chunks_live WINDOW w AS (PARTITION BY book_id ORDER BY ord, chunk_id)",
        "chunk_stats": f"WITH {_CHUNKS}, s AS (SELECT book_id, coalesce(char_count, 0) AS n FROM chunks_live) SELECT book_id, count(*) AS chunk_count, CAST(sum(n) AS BIGINT) AS total_chars, CAST(floor(avg(n) + 0.5) AS BIGINT) AS average_chunk_chars, CAST(min(n) AS BIGINT) AS min_chunk_chars, CAST(max(n) AS BIGINT) AS max_chunk_chars FROM s GROUP BY book_id",
        "short_chunks": f"WITH {_CHUNKS} SELECT book_id, count(*) FILTER (coalesce(length(text), 0) < 300) AS short_chunks FROM chunks_live GROUP BY book_id",
        "term_counts": f"{with_terms} SELECT book_id, chunk_id, term, count FROM counts",
        "postings_pruned": f"{with_terms} SELECT book_id, chunk_id, term, count FROM kept",
        "postings_top50": f"{with_terms} SELECT book_id, term, chunk_id, count, rank FROM posts",
        "chunk_keywords": f"{with_terms} SELECT book_id, chunk_id, string_agg(term, '|' ORDER BY n) AS keywords FROM words WHERE n <= 10 GROUP BY ALL",
        "keyword_back_fill": f"{with_terms}, k AS (SELECT book_id, chunk_id, string_agg(term, '|' ORDER BY n) AS k, count(*) AS c FROM words WHERE n <= 10 GROUP BY ALL) SELECT book_id, chunk_id, CAST(ord AS BIGINT) AS ord, coalesce(c, 0) AS n_keywords, coalesce(k, '') AS keywords FROM chunks_live LEFT JOIN k USING (book_id, chunk_id)",
        "chunk_index": f"{with_terms}, k AS (SELECT book_id, chunk_id, string_agg(term, '|' ORDER BY n) FILTER (n <= 20) AS k, count(*) AS c FROM words GROUP BY ALL) SELECT book_id, chunk_id, substring({_inline('text')}, 1, 160) AS preview, coalesce(c, 0) AS term_count, coalesce(k, '') AS terms FROM chunks_live LEFT JOIN k USING (book_id, chunk_id)",
        "index_summary": f"{with_terms} SELECT book_id, count(DISTINCT term) AS term_count, count(*) AS posting_count FROM posts GROUP BY book_id",
        "postings_valid": "WITH p AS (SELECT * FROM postings WHERE term IS NOT NULL AND chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, term, chunk_id ORDER BY indexed_at DESC NULLS LAST, hit_count DESC NULLS LAST) = 1) SELECT book_id, term, chunk_id, CAST(hit_count AS BIGINT) AS count FROM p WHERE hit_count > 0",
        "keyword_search_all": _keyword(KEYWORDS),
        "keyword_search_mixed": _keyword(BOTH, 25),
        "keyword_search_book": _keyword(KEYWORDS, chunks="own", first=f", own AS (SELECT * FROM chunks_live WHERE book_id = {_LARGEST})"),
        "keyword_fallback": f"""WITH {_CHUNKS}, {_query(MISSED)}, scan AS (SELECT book_id, chunk_id, ord, {_clean('text')} AS body FROM chunks_live),
have AS (SELECT s.book_id, s.chunk_id, s.ord, contains(s.body, qt.q) AS whole, qt.q, coalesce(sum(t.weight), 0) AS w, list(t.token ORDER BY t.pos) FILTER (t.token IS NOT NULL) AS m FROM scan s CROSS JOIN qt LEFT JOIN tok t ON contains(s.body, t.token) GROUP BY ALL)
SELECT book_id, chunk_id, CAST(ord AS BIGINT) AS ord, CAST(w + CASE WHEN whole THEN 4 ELSE 0 END AS BIGINT) AS score, array_to_string(coalesce(m, [q]), '|') AS matched FROM have WHERE w > 0 OR whole""",
        "exact_search_all": _exact("", False),
        "exact_search_book": _exact(f"AND book_id = {_LARGEST}", True),
        "occurrence_count": f"WITH s AS (SELECT doc_id, {_inline('text')} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, (length(t) - length(replace(t, 'the', ''))) // 3 AS n FROM s WHERE contains(t, 'the')",
        "highlight_context": f"""WITH {_CHUNKS}, h AS (SELECT doc_id, book_id, text, {_inline('text')} AS q FROM ({SPOTS})),
c AS (SELECT book_id, chunk_id, ord, {_inline('text')} AS body FROM chunks_live WHERE text IS NOT NULL),
x AS (SELECT h.doc_id, h.book_id, h.text, h.q, c.chunk_id, c.ord, c.body FROM h JOIN c USING (book_id) WHERE q <> '' AND contains(body, q) QUALIFY row_number() OVER (PARTITION BY doc_id, h.book_id ORDER BY ord, chunk_id) = 1)
SELECT doc_id, book_id, chunk_id, CAST(ord AS BIGINT) AS ord, CAST(100 + 5 * ((length(body) - length(replace(body, q, ''))) // length(q)) AS BIGINT) AS score, {_preview('body', 'text', '[text]', 260)} AS preview FROM x""",
        "progress_latest": f"WITH {_PROGRESS} SELECT book_id, last_chunk_id, next_chunk_id, status, note_path, array_to_string(current_themes, '|') AS current_themes, last_read_at, recency_seq FROM progress",
        "recent_books": f"WITH {_PROGRESS} SELECT book_id, last_read_at, recency_seq FROM progress ORDER BY last_read_at DESC NULLS LAST, recency_seq DESC, book_id LIMIT 20",
        "resume_books": f"WITH {_CHUNKS}, {_PROGRESS}, p AS (SELECT book_id, coalesce(next_chunk_id, last_chunk_id) AS chunk_id, last_read_at FROM progress) SELECT p.book_id, p.chunk_id, c.title, CAST(c.ord AS BIGINT) AS ord, CAST(c.char_count AS BIGINT) AS char_count, p.last_read_at, c.chunk_id IS NOT NULL AS found FROM p LEFT JOIN chunks_live c ON c.book_id = p.book_id AND c.chunk_id = p.chunk_id",
        "list_books": f"WITH {_BOOKS}, {_PROGRESS} SELECT b.book_id, b.title, b.author, b.imported_at, coalesce(nullif(b.index_status, ''), 'not_built') AS index_status, p.status AS reading_status, p.last_read_at FROM books_live b LEFT JOIN progress p USING (book_id)",
        "index_status": f"WITH {_BOOKS} SELECT coalesce(nullif(index_status, ''), 'not_built') AS index_status, count(*) AS books FROM books_live GROUP BY 1",
        "book_manifest": f"WITH {_CHUNKS} SELECT book_id, chunk_id, title, section_title, CAST(ord AS BIGINT) AS ord, chunk_path, CAST(char_count AS BIGINT) AS char_count, preview, array_to_string(keywords[1:20], '|') AS keywords FROM chunks_live QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY ord, chunk_id) <= 300",
        "note_sections": f"""WITH l AS (SELECT doc_id, string_split({_sub("coalesce(text, '')", "\\r\\n?", "chr(10)")}, chr(10)) AS a FROM documents WHERE doc_kind = 'note'),
x AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM l),
y AS (SELECT *, regexp_matches(line, '^##\\s+\\S') AS head, sum(CASE WHEN regexp_matches(line, '^##\\s+\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM x)
SELECT doc_id, CAST(sec - 1 AS BIGINT) AS section_no, max({_trim("regexp_replace(line, '^##\\s+', '')")}) FILTER (head) AS heading, {_trim("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '')")} AS content FROM y WHERE sec > 0 GROUP BY doc_id, sec""",
        "note_append": f"SELECT book_id, coalesce(string_agg('### note ' || doc_id || chr(10) || chr(10) || {_inline('text')}, chr(10) || chr(10) ORDER BY doc_id) FILTER (length({_inline('text')}) <= 20000), '') AS content, count(*) FILTER (length({_inline('text')}) > 20000) AS refused FROM documents WHERE doc_kind IN ('highlight', 'note') AND book_id IS NOT NULL GROUP BY book_id",
        "note_markdown_normal": f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# n' || chr(10) || chr(10) || '## 阅读恢复区' || chr(10) || {_sub('text', '\\r\\n?', 'chr(10)')} || chr(10) || '## 快速恢复区' || chr(10) || ' x' WHEN text IS NULL THEN '' ELSE {_sub('text', '\\r\\n?', 'chr(10)')} END AS t FROM documents) SELECT doc_id, coalesce({_sub('t', f'{_WS}+$', chr(39) * 2)}, '') || chr(10) AS markdown FROM t",
        "progress_deciding": f"WITH {_PROGRESS} SELECT book_id, last_chunk_id, next_chunk_id, status, note_path, array_to_string(current_themes, '|') AS current_themes, last_read_at, recency_seq FROM progress",
        "chunk_entries": f"""WITH {_CHUNKS}, f AS (SELECT book_id, chunk_id, coalesce(preview, '') AS preview FROM chunks QUALIFY row_number() OVER (PARTITION BY book_id, chunk_id ORDER BY loaded_at NULLS LAST, coalesce(preview, '')) = 1),
p AS (SELECT DISTINCT book_id, chunk_id FROM postings WHERE book_id IS NOT NULL AND chunk_id IS NOT NULL AND hit_count > 0), i AS (SELECT p.book_id, p.chunk_id, f.preview FROM p LEFT JOIN f USING (book_id, chunk_id))
SELECT coalesce(m.book_id, i.book_id) AS book_id, coalesce(m.chunk_id, i.chunk_id) AS chunk_id, coalesce(nullif(m.title, ''), m.chunk_id, i.chunk_id) AS chunk_title, nullif(m.section_title, '') AS section_title, coalesce('index/' || i.chunk_id, nullif(m.chunk_path, '')) AS chunk_path, CAST(coalesce(m.char_count, 0) AS BIGINT) AS char_count, CAST(coalesce(m.ord, 2147483647) AS BIGINT) AS ord, coalesce(nullif(i.preview, ''), m.preview, '') AS preview
FROM chunks_live m FULL OUTER JOIN i ON m.book_id = i.book_id AND m.chunk_id = i.chunk_id""",
        "note_skeletons": f"WITH {_SKELETONS} SELECT book_id, heading, ordinal, content FROM skeletons",
        "link_dedupe": "SELECT weread_book_id, entry_id, weread_title, updated_at FROM book_map WHERE weread_book_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY weread_book_id ORDER BY updated_at DESC NULLS LAST, received_at DESC NULLS LAST, entry_id DESC, weread_title DESC NULLS LAST) = 1",
        "link_remaining": f"WITH {_BOOKS} SELECT DISTINCT entry_id, weread_title FROM book_map WHERE weread_title IS NOT NULL AND weread_title NOT IN (SELECT title FROM books_live WHERE title IS NOT NULL AND book_id IN (SELECT book_id FROM progress_updates WHERE book_id IS NOT NULL))",
        "query_tokens": f"""WITH q AS (SELECT DISTINCT entry_id, weread_title AS query, {_clean('weread_title')} AS t FROM book_map WHERE weread_title IS NOT NULL),
w AS (SELECT entry_id, query, 0 AS g, i AS a, 0 AS b, lower(x) AS token FROM (SELECT entry_id, query, unnest(regexp_extract_all(t, '{_WORD}')) AS x, generate_subscripts(regexp_extract_all(t, '{_WORD}'), 1) AS i FROM q)),
r AS (SELECT entry_id, query, unnest(regexp_extract_all(t, '\\p{{Han}}+')) AS r, generate_subscripts(regexp_extract_all(t, '\\p{{Han}}+'), 1) AS a FROM q),
h AS (SELECT entry_id, query, 1 AS g, a, 0 AS b, r AS token FROM r WHERE length(r) BETWEEN 2 AND 3 UNION ALL SELECT entry_id, query, 1, a, i, substring(r, i, 2) FROM (SELECT *, unnest(range(1, length(r))) AS i FROM r)),
u AS (SELECT entry_id, query, token, min((g, a, b)) AS o FROM (SELECT * FROM w UNION ALL SELECT * FROM h) WHERE token NOT IN {_STOP} GROUP BY ALL),
v AS (SELECT entry_id, query, token, o FROM u UNION ALL SELECT entry_id, query, {_inline('query')}, NULL FROM q WHERE {_inline('query')} <> '' AND (entry_id, query) NOT IN (SELECT (entry_id, query) FROM u))
SELECT entry_id, query, row_number() OVER (PARTITION BY entry_id, query ORDER BY o) - 1 AS pos, token, CAST(CASE WHEN regexp_matches(token, '[A-Za-z]') OR length(token) >= 3 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM v""",
    }
    return out
