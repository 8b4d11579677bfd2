"""DuckDB SQL for the operators' queries, where SQL can express them."""

import string

from . import chat

_WORD = r"[^\x20\x09-\x0D]+"


def _near_duplicates(words: int = 4, percent: int = 80) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= {words} THEN list_transform(range(1, len(ws) - {words - 2}), lambda i: array_to_string(ws[i:i + {words - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.b, r.c FROM r JOIN links ON links.a = r.doc_id)
SELECT r.doc_id, CAST(COALESCE(MAX(n.n), 0) AS BIGINT) AS n_shingles, MIN(c) AS component_id, r.doc_id = MIN(c) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def _chat() -> str:
    said = "</s>[INST] ok [/INST]"
    escaped = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
    text, role = escaped.format(x="text"), f"replace({escaped.format(x='role')}, '|', '&#124;')"
    marks = len(chat.HEAD) + len(chat.HEAD_END) + len(chat.END)
    return f"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{said}' UNION ALL SELECT -1, 1, 'assistant', '{said}'),
g AS (SELECT conv_id, COUNT(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said, string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn) AS loss, SUM({marks} + length({role}) + length({text})) AS chars FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST({len(chat.BEGIN)} + chars AS BIGINT) AS formatted_chars FROM g"""


def _divergence(least: int = 10, top: int = 10) -> str:
    f = "({p} - {q}) * ({p} - {q}) // ({p} + {q})"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, translate(COALESCE(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS (SELECT lang, term, COUNT(*) AS c FROM w GROUP BY lang, term HAVING COUNT(DISTINCT id) >= {least}),
c AS (SELECT lang, source, term, COUNT(*) AS c FROM w SEMI JOIN t USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, COUNT(*) AS v, SUM(c) AS n FROM t GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, SUM(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, t.term, COALESCE(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (COALESCE(c.c, 0) + 2) // (COALESCE(n.n, 0) + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (t.c + 2) // (v.n + 2 * v.v) AS q FROM g JOIN t USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, SUM({f.format(p='a.p', q='b.p')}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, {f.format(p='p', q='q')} FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) x WHERE part = 'pair' OR rank <= {top}"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name. The others fit models, draw by hashes or call tokenizers; tests hold them against plain versions."""
    return {"op8_near_duplicates": _near_duplicates(), "op9_chat": _chat(), "op12_source_divergence": _divergence()}
