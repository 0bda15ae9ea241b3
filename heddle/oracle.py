"""SQL for DuckDB that stands beside the registered queries, built from shared parts."""

from __future__ import annotations

from .functions import text as T
from .operators import lexical as L
from .operators import retrieval as R


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quote(v) for v in values)


CAMEL = r"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
NORMAL = r"replace(lower({x}), '\', '/')"

DOCS = """docs AS (SELECT doc_id AS chunk_id, '/kb/' || source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang AS path,
  CAST(doc_id AS VARCHAR) || '.' || lang AS file_name, lang AS extension, 1 AS start_line,
  len(string_split(coalesce(text, ''), chr(10))) AS end_line,
  'L1-' || CAST(len(string_split(coalesce(text, ''), chr(10))) AS VARCHAR) AS source_location, coalesce(text, '') AS content FROM documents)"""
INDEXED = "concat_ws(chr(10), file_name, source_location, content)"


def concept_list(normal: str) -> str:
    compact = rf"regexp_replace({normal}, '\s+', '', 'g')"
    cases = []
    for name, phrases in T.CONCEPTS.items():
        test = " OR ".join(f"contains(c, {quote(p.replace(' ', ''))})" for p in phrases)
        cases.append(f"CASE WHEN {test} THEN {quote(name)} END")
    return f"(SELECT list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL) FROM (SELECT {compact} AS c))"


def token_rows(key: str, source: str, text: str, latin: float, concept: float) -> str:
    normal = NORMAL.format(x=CAMEL.format(x=text))
    return f"""SELECT {key}, token, sum(w) AS weight FROM (
    SELECT {key}, unnest(regexp_extract_all(normal, '[a-z0-9]+')) AS token, CAST({latin} AS DOUBLE) AS w FROM (SELECT {key}, {normal} AS normal FROM {source})
    UNION ALL SELECT {key}, 'concept:' || unnest({concept_list('normal')}), CAST({concept} AS DOUBLE) FROM (SELECT {key}, {normal} AS normal FROM {source})
  ) WHERE length(token) > 1 AND token NOT IN ({listed(T.STOP_WORDS)}) GROUP BY {key}, token"""


POSTINGS = f"""{DOCS},
post AS ({token_rows('chunk_id', 'docs', INDEXED, T.LATIN, T.CONCEPT_WEIGHT)}),
lens AS (SELECT d.chunk_id, greatest(1.0, coalesce(sum(weight), 0)) AS length FROM docs d LEFT JOIN post USING (chunk_id) GROUP BY d.chunk_id),
corpus AS (SELECT count(*) AS n, greatest(1.0, avg(length)) AS avg_length FROM lens),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token)"""


def subject(x: str) -> str:
    clean = rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"
    s = rf"regexp_replace(regexp_replace(regexp_replace({clean}, {quote(T.FRAMING)}, ' ', 'g'), '[？?，,：:]+', ' ', 'g'), '\s+', ' ', 'g')"
    s = rf"regexp_replace({s}, '^\s+|\s+$', '', 'g')"
    s = rf"regexp_replace(regexp_replace(regexp_replace({s}, {quote(T.TRAILING_NOISE)}, ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN {s} = '' THEN {clean} ELSE {s} END"


QUERIES = f"""qs AS (SELECT item_id AS qid, coalesce(text, '') AS query, {subject('text')} AS subject,
  regexp_matches(coalesce(text, ''), {quote(T.CODE_INTENT)}) AS code_intent, regexp_matches(coalesce(text, ''), {quote(T.LOCATION_INTENT)}) AS location_intent
  FROM benchmark WHERE trim(coalesce(text, '')) <> ''),
terms AS ({token_rows('qid', 'qs', 'subject', T.QUERY_LATIN, T.QUERY_CONCEPT_WEIGHT)})"""


def bm25(extension: str | None = None) -> str:
    only = f"AND lower(d.extension) = {quote(extension)}" if extension else ""
    return f"""bm AS (SELECT qid, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (p.weight * {L.K1 + 1} / (p.weight + {L.K1} * ({1 - L.B} + {L.B} * length / avg_length)))
    * least(greatest(t.weight, {L.QUERY_WEIGHT[0]}), {L.QUERY_WEIGHT[1]})) AS bm25
  FROM terms t JOIN post p USING (token) JOIN df USING (token) JOIN lens USING (chunk_id) JOIN docs d USING (chunk_id) CROSS JOIN corpus WHERE true {only} GROUP BY qid, chunk_id HAVING bm25 > 0),
sparse AS (SELECT * FROM (SELECT b.*, path, file_name, source_location, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, file_name, source_location, chunk_id) AS rank
  FROM bm b JOIN docs USING (chunk_id)) WHERE rank <= {R.BRANCH})"""


def histogram(x: str) -> str:
    codes = f"list_transform(string_split({x}, ''), lambda c: ascii(c) % 8)"
    counts = f"list_transform(range(8), lambda b: CAST(len(list_filter(codes, lambda c: c = b)) AS DOUBLE))"
    return f"(SELECT list_transform(k, lambda v: v / sqrt(list_sum(list_transform(k, lambda u: u * u)))) FROM (SELECT {counts} AS k FROM (SELECT {codes} AS codes)))"


DENSE = f"""dv AS (SELECT chunk_id, {histogram(INDEXED)} AS v FROM docs),
qv AS (SELECT qid, {histogram('subject')} AS q FROM qs WHERE subject <> ''),
ds AS (SELECT qid, chunk_id, greatest(0, list_dot_product(q, v) / sqrt(list_dot_product(q, q) * list_dot_product(v, v))) AS dense FROM qv CROSS JOIN dv),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dense, 6) DESC, chunk_id) AS rank FROM ds WHERE dense >= 0.15) WHERE rank <= {R.BRANCH})"""

FUSED = f"""fused AS (SELECT qid, chunk_id, max(bm25) AS bm25, max(dense) AS dense, sum(1.0 / ({R.RRF_K} + rank)) AS rrf, min(seq) AS seq FROM (
    SELECT qid, chunk_id, bm25, 0.0 AS dense, rank, rank AS seq FROM sparse UNION ALL SELECT qid, chunk_id, 0.0, dense, rank, rank + 1000000 FROM dense) GROUP BY qid, chunk_id),
norm AS (SELECT qid, chunk_id, coalesce(least(1.0, greatest(0.0, bm25 / nullif(max(bm25) OVER (PARTITION BY qid), 0))), 0.0) AS bm25, least(1.0, greatest(0.0, dense)) AS dense, rrf, seq,
    least(1.0, rrf / max(rrf) OVER (PARTITION BY qid)) AS fusion FROM fused)"""


def pool(limit: int) -> str:
    return f"""pool AS (SELECT * FROM (SELECT f.*, path, file_name, source_location, row_number() OVER (PARTITION BY qid ORDER BY round(fusion, 6) DESC, file_name, seq) AS r
  FROM norm f JOIN docs USING (chunk_id)) WHERE r <= {max(4 * limit, R.POOL)})"""


_W = "list_filter(words, lambda w: {test})"
_DECL = " OR ".join([*(f"contains(content, '{k} ' || w)" for k in ("class", "interface", "record", "enum", "def", "function")), "contains(content, ' ' || w || '(')", "starts_with(content, w || '(')"])
FEATURES = f"""
tf AS (SELECT chunk_id, token, (1 + ln(greatest(1.0, weight))) * ln(1 + (n + 1) / (df + 1)) AS d FROM post JOIN df USING (token) CROSS JOIN corpus WHERE chunk_id IN (SELECT chunk_id FROM pool)),
tq AS (SELECT qid, token, (1 + ln(greatest(1.0, weight))) * ln(1 + (n + 1) / (coalesce(df, 0) + 1)) AS q FROM terms LEFT JOIN df USING (token) CROSS JOIN corpus),
dn AS (SELECT chunk_id, sqrt(sum(d * d)) AS dn FROM tf GROUP BY chunk_id), qn AS (SELECT qid, sqrt(sum(q * q)) AS qn FROM tq GROUP BY qid),
dots AS (SELECT p.qid, p.chunk_id, sum(q * d) AS dot, count(*) FILTER (starts_with(token, 'concept:')) AS cm FROM pool p JOIN tq USING (qid) JOIN tf USING (chunk_id, token) GROUP BY p.qid, p.chunk_id),
words AS (SELECT qid, list(token) AS words FROM terms WHERE NOT starts_with(token, 'concept:') GROUP BY qid),
raw AS (SELECT p.qid, p.chunk_id, code_intent, location_intent, coalesce(dot / nullif(qn * dn, 0), 0.0) AS cosine, {NORMAL.format(x='d.content')} AS content, {NORMAL.format(x='d.file_name')} AS fname, {NORMAL.format(x='d.path')} AS dpath,
    {NORMAL.format(x='subject')} AS normal, coalesce(words, []) AS words, coalesce(cm, 0) AS concept_matches, lower(d.extension) AS ext
  FROM pool p JOIN docs d USING (chunk_id) JOIN qs USING (qid) LEFT JOIN words USING (qid) LEFT JOIN qn USING (qid) LEFT JOIN dn USING (chunk_id) LEFT JOIN dots USING (qid, chunk_id)),
feats AS (SELECT qid, chunk_id, code_intent, location_intent, cosine, contains(content, normal) AS exact, len({_W.format(test="contains(fname, w)")}) AS name_matches, len({_W.format(test="contains(dpath, w)")}) AS path_matches,
    concept_matches, len({_W.format(test=f"length(w) >= 3 AND ({_DECL})")}) AS declarations, code_intent AND ext IN ({listed(T.SCORED_CODE_EXTENSIONS)}) AS code_file FROM raw),
feat AS (SELECT *, code_intent OR location_intent AS focused, cosine * 0.74 + CASE WHEN exact THEN 0.24 ELSE 0 END + name_matches * CASE WHEN code_intent OR location_intent THEN 0.09 ELSE 0.035 END
    + least(0.18, path_matches * CASE WHEN location_intent THEN 0.055 ELSE 0.02 END) + least(0.30, concept_matches * 0.10) + CASE WHEN code_file THEN 0.09 ELSE 0 END + least(0.32, declarations * 0.16) AS feature FROM feats)"""
RERANKED = """rr AS (SELECT p.*, f.focused, feature, CASE WHEN feature <= 0 THEN 0 ELSE 1 - exp(-feature) END AS s FROM pool p JOIN feat f USING (qid, chunk_id)),
fin AS (SELECT *, least(1.0, greatest(0.0, CASE WHEN focused THEN fusion * 0.35 + bm25 * 0.20 + dense * 0.10 + s * 0.35 ELSE fusion * 0.40 + bm25 * 0.20 + dense * 0.25 + s * 0.15 END)) AS score FROM rr)"""


def capped(source: str, score: str, limit: int, ties: str) -> str:
    return f"""cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY round({score}, 6) DESC, {ties}) AS of_path FROM {source}) WHERE of_path <= {R.PER_DOCUMENT}),
res AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round({score}, 6) DESC, {ties}) AS rnk FROM cap)"""
