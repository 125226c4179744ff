"""SQL of the recognisers of dates and entities: places of matches, the sentences around them, and what follows."""

from __future__ import annotations

from types import SimpleNamespace

from lectern.functions import matching as m
from lectern.functions import text as t

BEHIND = r"(?<!\w)"
SPACE = r"[\s\v\x{85}\x{a0}\x{1c}-\x{1f}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def found(number: int, category: str, pattern, source: str = "c", keys: str = "document_id, chunk_id") -> str:
    """Rows (keys, pattern, category, a, n) of all matches in `text` of `source`: the first character, from 0, and how many.

    Without positions in SQL, a match begins where the pieces between the matches before it, and these, end. A long
    s is an s where case is ignored; it takes one character as well.
    """
    flags = "(?i)" if pattern.flags & m.re.I else ""
    ignoring = f"CASE WHEN '{flags}' <> '' THEN replace(text, 'ſ', 's') ELSE text END"
    rule = _quoted(flags + pattern.pattern.replace(BEHIND, "").replace(r"[\w", r"[\p{L}\p{N}_"))
    # looking behind a match is done once it is found; only what begins with a sign of money is so bound
    free = f" WHERE a = 0 OR n = 0 OR NOT regexp_matches(before, '[\\p{{L}}\\p{{N}}_]') OR regexp_matches(first, '[0-9]')" if BEHIND in pattern.pattern else ""
    rows = f"""SELECT {keys}, {number} AS pattern, '{category}' AS category, ms[i][1:1] AS first, right(segs[i], 1) AS before, CAST(coalesce(list_sum([length(x) FOR x IN segs[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0) AS BIGINT) AS a, CAST(length(ms[i]) AS BIGINT) AS n
      FROM (SELECT {keys}, segs, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT {keys}, regexp_split_to_array({ignoring}, {rule}) AS segs, regexp_extract_all({ignoring}, {rule}) AS ms FROM {source} WHERE text IS NOT NULL) WHERE len(ms) > 0)"""
    return f"(SELECT {keys}, pattern, category, a, n FROM ({rows}){free})"


def around(limit: int) -> str:
    """The sentence around characters a..a + n of `text`, or all of it where the match holds a sentence's end."""
    match, before, after = "text[a + 1:a + n]", "text[1:a]", "text[a + n + 1:]"
    left = f"regexp_extract({before}, '(?s)^(?:.*(?:[.!?]{SPACE}+|\\n+))?(.*)$', 1)"
    right = f"regexp_extract({after}, '(?s)^(.*?)(?:\\n|[.!?]{SPACE}|\\z)', 1) || regexp_extract({after}, '(?s)^(.*?)(?:\\n|([.!?]){SPACE}|\\z)', 2)"
    whole = f"CASE WHEN regexp_matches({match}, '\\n|[.!?]{SPACE}') THEN text ELSE {left} || {match} || {right} END"
    return f"trim(regexp_replace({whole}, '{SPACE}+', ' ', 'g'), ' ')[1:{limit}]"


def _events() -> str:
    parts, kept = [], []
    for k, (precision, pattern) in enumerate(m.DATE_KINDS):
        free = "" if not kept else " WHERE NOT EXISTS (FROM (" + " UNION ALL ".join(f"SELECT * FROM d{j}" for j in kept) + ") o WHERE o.document_id = x.document_id AND o.chunk_id = x.chunk_id AND x.a < o.a + o.n AND o.a < x.a + x.n)"
        parts.append(f"d{k} AS (SELECT * FROM {found(k, precision, pattern)} x{free})")
        kept.append(k)
    rows = " UNION ALL ".join(f"SELECT * FROM d{k}" for k in kept)
    types = "CASE " + " ".join("WHEN (" + " OR ".join(f"contains(lower(event), '{w}')" for w in words) + f") THEN '{label}'" for label, words in t.EVENT_TYPES.items()) + f" ELSE '{t.OTHER_EVENT}' END"
    months = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
    return ", ".join(parts) + f""",
    dated AS (SELECT c.*, d.category AS date_precision, text[a + 1:a + n] AS date, {around(900)} AS event FROM ({rows}) d JOIN c USING (document_id, chunk_id)),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number, lower(date), lower(event) ORDER BY chunk_ord, chunk_id, date, date_precision, event) AS again FROM dated),
    read AS (SELECT *, {types} AS event_type, try_strptime(regexp_replace(regexp_replace(replace(regexp_replace(replace(date, 'ſ', 's'), '(?i)(\\d)(st|nd|rd|th)\\b', '\\1', 'g'), ',', ''), '(?i)\\bSept\\b', 'Sep', 'g'), '\\s+', ' ', 'g'), ['%Y-%m-%d', '%Y/%m/%d', '%d %B %Y', '%d %b %Y', '%B %d %Y', '%b %d %Y']) AS day FROM firsts WHERE again = 1),
    events AS (SELECT * EXCLUDE (again, day), CASE WHEN date_precision = 'exact' AND day IS NOT NULL THEN {{'y': year(day), 'm': month(day), 'd': day(day), 'r': 0, 't': lower(date)}}
      WHEN date_precision = 'month' THEN {{'y': CAST(regexp_extract(date, '((?:19|20)\\d{{2}})$', 1) AS BIGINT), 'm': CAST(list_position({months}, lower(date)[1:3]) AS BIGINT), 'd': 0, 'r': 1, 't': lower(date)}}
      WHEN date_precision = 'fiscal' THEN {{'y': CAST(regexp_extract(date, '(?:19|20)\\d{{2}}') AS BIGINT), 'm': 1, 'd': 0, 'r': 2, 't': lower(date)}}
      ELSE {{'y': 9999, 'm': 12, 'd': 31, 'r': 3, 't': lower(date)}} END AS key FROM read)"""


def _references() -> str:
    rows = " UNION ALL ".join(f"SELECT * FROM {found(k, category, pattern)}" for k, (category, pattern) in enumerate(m.ENTITY_KINDS))
    place = next(p.pattern for category, p in m.ENTITY_KINDS if category == "Locations")
    defence = "(" + " OR ".join(f"contains(lower(entity), '{w}')" for w in t.DEFENCE_WORDS) + ")"
    edges = r"^[ \t\n,.;:()\[\]]+|[ \t\n,.;:()\[\]]+$"
    return f"""seen AS (SELECT c.*, s.pattern, s.category AS kind, a, n, CASE WHEN s.category = 'Locations' THEN regexp_extract(text[a + 1:a + n], {_quoted(place)}, 1) ELSE text[a + 1:a + n] END AS raw, {around(700)} AS context FROM ({rows}) s JOIN c USING (document_id, chunk_id)),
    cleaned AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), {_quoted(edges)}, '', 'g'), '^The\\s+', '') AS e0 FROM seen),
    named AS (SELECT *, CASE WHEN kind = 'Organizations' THEN regexp_split_to_array(e0, '\\s+and\\s+(?:the\\s+)?')[-1] ELSE e0 END AS entity FROM cleaned),
    sorted AS (SELECT *, CASE WHEN kind = 'Organizations' AND {defence} THEN 'Defence organizations' ELSE kind END AS category, trim(regexp_replace(lower(entity), '[^a-z0-9]+', ' ', 'g'), ' ') AS canonical FROM named WHERE entity <> '' AND length(entity) <= 180),
    placed AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id, a, n, canonical ORDER BY pattern, entity) AS again FROM sorted WHERE canonical <> ''),
    single AS (SELECT * EXCLUDE (again), row_number() OVER (PARTITION BY category, canonical, document_id, page_number, chunk_id, context ORDER BY pattern, a, entity) AS again FROM placed WHERE again = 1),
    refs AS (SELECT * EXCLUDE (again) FROM single WHERE again = 1),
    merged AS (SELECT category, canonical, arg_min(entity, {{'d': document_id, 'p': page_number, 'o': chunk_ord, 'k': pattern, 'a': a, 'e': entity}}) AS entity, count(*) AS "references", count(DISTINCT document_id) AS documents FROM refs GROUP BY ALL)"""


def _citations() -> str:
    """`cites` (paper_id, style, marker, target, year, a, n) and `quotes` (paper_id, a, n) of `pp` (paper_id, body)."""
    rows = {k: found(0, k, p, "texts", "paper_id") for k, p in (("numeric", m.NUMERIC), ("author-year", m.AUTHOR_YEAR), ("DOI", m.DOI), ("quote", m.QUOTE))}
    name = _quoted(m.AUTHOR_YEAR.pattern.replace(r"[\w", r"[\p{L}\p{N}_"))
    return f"""texts AS (SELECT paper_id, body AS text FROM pp WHERE body IS NOT NULL),
    hits AS (SELECT h.*, text[a + 1:a + n] AS hit, text[1:a] AS ahead FROM ({" UNION ALL ".join(f"SELECT * FROM {rows[k]}" for k in ("numeric", "author-year", "DOI"))}) h JOIN texts USING (paper_id)),
    parts AS (SELECT paper_id, a, n, unnest(regexp_split_to_array(hit[2:-2], '[,;]')) AS part FROM hits WHERE category = 'numeric'),
    ends AS (SELECT paper_id, a, n, [CAST(trim(x) AS BIGINT) FOR x IN regexp_split_to_array(trim(part), '[–\\-]')] AS e FROM parts),
    labels AS (SELECT DISTINCT paper_id, a, n, unnest(CASE WHEN len(e) = 2 THEN CASE WHEN e[2] >= e[1] AND e[2] - e[1] <= 100 THEN range(e[1], e[2] + 1) ELSE [] END ELSE [e[1]] END) AS label FROM ends),
    cites AS (SELECT paper_id, 'numeric' AS style, '[' || label || ']' AS marker, CAST(label AS VARCHAR) AS target, '' AS year, a, n FROM labels
      UNION ALL SELECT paper_id, category, hit, lower(regexp_extract(hit, {name}, 1)), regexp_extract(hit, {name}, 2), a, n FROM hits WHERE category = 'author-year' AND (regexp_extract(ahead, '(?s)^.*([()])', 1) = '(' OR contains(hit, ',') OR contains(hit, '('))
      UNION ALL SELECT paper_id, category, hit, lower(rtrim(hit, '.,;:)]}}')), '', a, n FROM hits WHERE category = 'DOI'),
    quotes AS (SELECT paper_id, a, n FROM {rows["quote"]})"""


def _windows(capacity: int) -> str:
    """`words` (paper_id, a, n) and `wins` (paper_id, window_no, start, end_, tokens): windows of at most `capacity`
    tokens of the papers `pp` that end between words."""
    word, token = SimpleNamespace(pattern=r"[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*", flags=0), SimpleNamespace(pattern=r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\v\x{85}\x{a0}\x{2028}\x{2029}]", flags=0)
    return f"""texts AS (SELECT paper_id, body AS text FROM pp WHERE body IS NOT NULL),
    words AS (SELECT paper_id, a, n FROM {found(0, "word", word, "texts", "paper_id")}),
    toks AS (SELECT paper_id, a, n, row_number() OVER (PARTITION BY paper_id ORDER BY a) - 1 AS i FROM {found(0, "token", token, "texts", "paper_id")}),
    owned AS (SELECT t.*, w.a AS word FROM toks t LEFT JOIN words w ON w.paper_id = t.paper_id AND w.a <= t.a AND t.a < w.a + w.n),
    firsts AS (SELECT *, CASE WHEN word IS NULL THEN i ELSE min(i) OVER (PARTITION BY paper_id, word) END AS first, count(*) OVER (PARTITION BY paper_id) AS total FROM owned),
    steps AS (SELECT paper_id, 0 AS window_no, CAST(0 AS BIGINT) AS i, CASE WHEN total <= {capacity} THEN total ELSE (SELECT f.first FROM firsts f WHERE f.paper_id = x.paper_id AND f.i = {capacity}) END AS stop, total FROM firsts x WHERE i = 0
      UNION ALL SELECT s.paper_id, s.window_no + 1, s.stop, CASE WHEN s.stop + {capacity} >= s.total THEN s.total ELSE f.first END, s.total FROM steps s LEFT JOIN firsts f ON f.paper_id = s.paper_id AND f.i = s.stop + {capacity} WHERE s.stop < s.total),
    wins AS (SELECT s.paper_id, CAST(window_no AS INTEGER) AS window_no, CAST(b.a AS INTEGER) AS start, CAST(e.a + e.n AS INTEGER) AS end_, CAST(stop - s.i AS INTEGER) AS tokens FROM steps s JOIN toks b ON b.paper_id = s.paper_id AND b.i = s.i JOIN toks e ON e.paper_id = s.paper_id AND e.i = s.stop - 1)"""


EVENTS, REFERENCES, CITATIONS, WINDOWS = _events(), _references(), _citations(), _windows(128)
