"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from codeloom.llm.license_scan import BASE, LEAST_COVERAGE, SCORE_DIGITS, TEMPLATES, Templates
from codeloom.llm.near_dup import THRESHOLD as JACCARD
from codeloom.llm.embedding_dedup import THRESHOLD as COSINE
from codeloom.llm.url_filter import BLOCKED, RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: ``pairs`` (both directions) of ``nodes``: link counts and the least node that each can reach.
_CLASSES = """
reach AS (
  SELECT node, node AS other FROM nodes
  UNION
  SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.other
),
least AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
degree AS (SELECT a AS node, count(*) AS n_links FROM pairs GROUP BY a)
"""

OP4 = f"""
WITH RECURSIVE vecs AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
),
nodes AS (SELECT vec_id AS node FROM embeddings),
pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vecs x JOIN vecs y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= {COSINE}
),
{_CLASSES}
SELECT n.node AS vec_id, coalesce(d.n_links, 0) AS n_links, l.class_id AS component_id, n.node = l.class_id AS kept
FROM nodes n JOIN least l ON l.node = n.node LEFT JOIN degree d ON d.node = n.node
"""

OP9 = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
nodes AS (SELECT doc_id AS node FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
),
pairs AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE CAST(c.n AS DOUBLE) / (x.n + y.n - c.n) >= {JACCARD}
),
{_CLASSES}
SELECT n.node AS doc_id, coalesce(d.n_links, 0) AS n_links, l.class_id, n.node = l.class_id AS kept
FROM nodes n JOIN least l ON l.node = n.node LEFT JOIN degree d ON d.node = n.node
"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


OP10 = f"""
WITH urls AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
entries AS (
  SELECT entry, verdict, substr(entry, 1, instr(entry, '/') - 1) AS h, substr(entry, instr(entry, '/')) AS p
  FROM (VALUES {_values([*RULES, *((x, "listed") for x in BLOCKED)])}) AS t(entry, verdict)
),
fits AS (
  SELECT u.page_id, e.entry, e.verdict,
    row_number() OVER (PARTITION BY u.page_id, e.verdict = 'listed' ORDER BY length(e.entry) DESC, length(e.h) DESC, e.entry DESC) AS k
  FROM urls u JOIN entries e ON (u.host = e.h OR ends_with(u.host, '.' || e.h)) AND starts_with(u.path, e.p)
)
SELECT u.page_id, u.host, u.path, r.entry AS rule,
  CASE WHEN r.verdict = 'block' OR (r.verdict IS NULL AND l.entry IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict,
  l.entry AS listed
FROM urls u
LEFT JOIN fits r ON r.page_id = u.page_id AND r.k = 1 AND r.verdict <> 'listed'
LEFT JOIN fits l ON l.page_id = u.page_id AND l.k = 1 AND l.verdict = 'listed'
"""

#: Without the index: every template word of every file votes for a template and a relative position.
OP8 = f"""
WITH worded AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
placed AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM worded),
phrases AS (SELECT string_split(phrase, ' ') AS words, label FROM (VALUES {_values(BASE.items())}) AS t(phrase, label)),
base AS (
  SELECT p.r, p.p, b.label FROM placed p JOIN phrases b ON p.word = b.words[1] JOIN worded d ON d.r = p.r
  WHERE d.w[p.p + 1 : p.p + len(b.words)] = b.words
),
lines AS (
  SELECT CAST(t AS INT) AS t, label, string_split(line, ' ') AS words, CAST(string_split(must, ' ') AS INT[]) AS must
  FROM (VALUES {_values((t, TEMPLATES[t][0], TEMPLATES[t][1], " ".join(map(str, sorted(set(m))))) for t, m in enumerate(Templates().mandatory))}) AS t(t, label, line, must)
),
wanted AS (SELECT t, must, unnest(words) AS word, unnest(range(0, len(words))) AS q FROM lines),
seen AS (SELECT word, count(DISTINCT r) AS n FROM placed WHERE word IN (SELECT word FROM wanted) GROUP BY word),
weighed AS (
  SELECT w.t, w.q, w.word, list_contains(w.must, w.q) AS needed,
    greatest(0.0, coalesce(ln((a.docs + 1) / (s.n + 0.5)), ln(1.0 + a.docs))) AS idf
  FROM wanted w CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS docs FROM worded) a LEFT JOIN seen s ON s.word = w.word
),
whole AS (SELECT t, sum(idf) AS idf, count(*) AS n, count(*) FILTER (needed) AS needed FROM weighed GROUP BY t),
aligned AS (
  SELECT p.r, x.t, p.p - x.q AS shift, sum(x.idf) AS idf, count(*) AS n, count(*) FILTER (x.needed) AS needed
  FROM placed p JOIN weighed x ON x.word = p.word GROUP BY p.r, x.t, p.p - x.q
),
fits AS (
  SELECT a.r, l.label, CASE WHEN w.idf > 0 THEN a.idf / w.idf ELSE a.n / w.n END AS share
  FROM aligned a JOIN whole w ON w.t = a.t JOIN lines l ON l.t = a.t WHERE a.needed = w.needed
),
found AS (SELECT r, label, least(share, 1.0) AS share FROM fits WHERE share >= {LEAST_COVERAGE}),
places AS (SELECT r, count(*) AS n, min(p) AS lo, max(p) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r),
every AS (SELECT r, label FROM base UNION SELECT r, label FROM found),
labelled AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY r),
scored AS (SELECT r, max(share) AS score FROM found GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word, coalesce(b.labels, '') AS base_labels,
  coalesce(l.labels, '') AS labels, round(coalesce(s.score, 0.0), {SCORE_DIGITS}) AS score
FROM worded d LEFT JOIN places b ON b.r = d.r LEFT JOIN labelled l ON l.r = d.r LEFT JOIN scored s ON s.r = d.r
"""

ORACLES: dict[str, str] = {"op4_embedding_dedup": OP4, "op8_license_scan": OP8, "op9_jaccard_join": OP9, "op10_url_filter": OP10}
