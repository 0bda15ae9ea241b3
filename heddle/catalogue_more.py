"""Queries of chunking, planning, conversations, evaluation and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import oracle as O
from .catalogue import _HYBRID, _index, query
from .functions import text as T
from .operators import chunking as K
from .operators import context as X
from .operators import control as N
from .operators import conversation as V
from .operators import evaluate as E
from .operators import highlight as G
from .operators import iterate as I
from .operators import lexical as L
from .operators import planner as P
from .operators import published as PI
from .operators import retrieval as R
from .plans.stored import stored
from .sources import corpus as C
from .sources import html as H
from .streaming import freshness as W
from .streaming import sessions as SS

WIDE = r"[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"


def _wide(x: str) -> str:
    return f"length(regexp_replace({x}, '{WIDE}', '', 'g'))"


# chunks

_CHUNKS = rf"""RECURSIVE {O.DOCS},
l AS (SELECT chunk_id, path, unnest(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS raw, generate_subscripts(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS i FROM docs),
s AS (SELECT chunk_id, path, i, regexp_replace(raw, '\s+$', '') AS line FROM l),
u AS (SELECT *, line = '' AS blank, greatest(1, {_wide('line')} + CAST(ceil((length(line) - {_wide('line')}) / 4) AS INTEGER)) AS tok FROM s),
p AS (SELECT *, sum(tok) OVER (PARTITION BY chunk_id ORDER BY i) AS p, max(i) OVER (PARTITION BY chunk_id) AS n FROM u),
back AS (SELECT a.chunk_id, a.i, max(b.i) AS s FROM p a JOIN p b ON a.chunk_id = b.chunk_id AND b.i <= a.i AND a.p - b.p + b.tok >= {K.OVERLAP} GROUP BY a.chunk_id, a.i),
w AS (SELECT p.*, coalesce(s, 1) AS back FROM p LEFT JOIN back USING (chunk_id, i)),
f AS (SELECT chunk_id, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS start, CAST(0 AS HUGEINT) AS before, CAST(NULL AS BIGINT) AS ea FROM docs
  UNION ALL SELECT w.chunk_id, w.i, CASE WHEN w.p - f.before >= {K.TARGET} THEN greatest(f.start, w.back) WHEN w.blank AND w.p - f.before >= {K.PARAGRAPH} THEN w.i + 1 ELSE f.start END,
    CASE WHEN w.p - f.before >= {K.TARGET} THEN w.p - list_sum(list_slice(tk, greatest(f.start, w.back), w.i)) WHEN w.blank AND w.p - f.before >= {K.PARAGRAPH} THEN w.p ELSE f.before END,
    CASE WHEN w.p - f.before >= {K.TARGET} OR (w.blank AND w.p - f.before >= {K.PARAGRAPH}) THEN f.start END
  FROM f JOIN w ON w.chunk_id = f.chunk_id AND w.i = f.i + 1 JOIN (SELECT chunk_id, list(tok ORDER BY i) AS tk FROM p GROUP BY chunk_id) t ON t.chunk_id = w.chunk_id),
e AS (SELECT chunk_id, ea AS a, i AS b FROM f WHERE ea IS NOT NULL UNION ALL SELECT f.chunk_id, f.start, f.i FROM f JOIN (SELECT chunk_id, max(i) AS n FROM u GROUP BY chunk_id) x ON x.chunk_id = f.chunk_id AND x.n = f.i WHERE f.start <= f.i),
c AS (SELECT e.chunk_id, min(u.path) AS path, e.a, e.b, min(u.i) AS start_line, max(u.i) AS end_line FROM e JOIN u ON u.chunk_id = e.chunk_id AND u.i BETWEEN e.a AND e.b AND NOT u.blank GROUP BY e.chunk_id, e.a, e.b),
t AS (SELECT c.chunk_id AS doc_id, c.path, c.start_line, c.end_line, regexp_replace(string_agg(line, chr(10) ORDER BY u.i), '^\s+|\s+$', '', 'g') AS content FROM c JOIN u ON u.chunk_id = c.chunk_id AND u.i BETWEEN c.start_line AND c.end_line GROUP BY c.chunk_id, c.path, c.a, c.b, c.start_line, c.end_line),
chunks AS (SELECT *, sha1(path || ':' || 'L' || start_line || '-' || end_line || ':' || content) AS chunk_id FROM t WHERE length(content) >= {K.LEAST})"""


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(length(content) AS INTEGER) AS n_chars FROM chunks")
def chunk_prose(spark, sf_dir):
    """Prose chunks of every document."""
    return K.chunks(C.whole_documents(spark, sf_dir)).select("doc_id", "chunk_id", "start_line", "end_line", F.length("content").alias("n_chars"))


@query(f"WITH {_CHUNKS} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS files, CAST(sum(2 * length(content) + 2 * length(chunk_id) + 2 * length(path) + 64) AS BIGINT) * 1000 // count(*) AS memory_per_1000 FROM chunks")
def corpus_view(spark, sf_dir):
    """Chunks, files, and the estimated memory of 1000 chunks without vectors."""
    size = 2 * F.length("content") + 2 * F.length("chunk_id") + 2 * F.length("path") + 64
    return K.chunks(C.whole_documents(spark, sf_dir)).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("files"), F.expr("1").alias("_"), F.sum(size).alias("s")).select("chunks", "files", F.expr("s * 1000 div chunks").alias("memory_per_1000"))


@query(f"""WITH {_CHUNKS}, o AS (SELECT *, lag(chunk_id) OVER w AS pid, lag(end_line) OVER w AS pe, lag(length(content)) OVER w AS ps, lead(chunk_id) OVER w AS nid, lead(start_line) OVER w AS ns, lead(length(content)) OVER w AS nz
  FROM chunks WINDOW w AS (PARTITION BY path ORDER BY start_line, end_line, chunk_id)),
b AS (SELECT *, coalesce(pe < start_line AND length(content) + ps <= {X.EXPANDED - 2}, false) AS ok FROM o)
SELECT chunk_id, CASE WHEN ok THEN pid END AS before, CASE WHEN ns > end_line AND length(content) + CASE WHEN ok THEN ps + 2 ELSE 0 END + nz <= {X.EXPANDED - 2} THEN nid END AS after FROM b""")
def neighbour_expansion(spark, sf_dir):
    """The chunks before and after each that may join it in a context."""
    return X.neighbours(K.chunks(C.whole_documents(spark, sf_dir)))


@query()
def mmr_context(spark, sf_dir):
    """Diverse picks among the hybrid results of each benchmark item (J9, D11, H2, I15). A greedy loop: no SQL."""
    index = _index(spark, sf_dir)
    found = R.search(index, C.benchmark_queries(spark, sf_dir), limit=max(20, 4 * 6))
    return X.select(R.with_chunks(found, index, "content"), 6).withColumn("score", F.round("score", 6))


def _over_chunks(spark, sf_dir):
    """A search over prose chunks, by BM25."""
    index = PI.of_chunks(spark, sf_dir).load().index
    return index, lambda queries, limit: R.with_chunks(R.search(index, queries, "BM25", limit, explain=False), index, "source_location", "start_line", "end_line", "content")


@query()
def context_expansion(spark, sf_dir):
    """Diverse picks among the chunks of each benchmark item, with their neighbours (J9, G4). A greedy loop: no SQL."""
    index, search = _over_chunks(spark, sf_dir)
    picks = stored(X.select(search(C.benchmark_queries(spark, sf_dir), 24), 6))
    return X.expanded(picks, index.chunks).withColumn("score", F.round("score", 6))


_CITED = f"WITH {O.POSTINGS}, {O.QUERIES}, {O.bm25()}, s AS (SELECT sp.qid, rank, sp.path, sp.source_location, content FROM sparse sp JOIN docs USING (chunk_id) WHERE rank <= 20)"
_HEAD = "'[' || rank || '] ' || path || ' · ' || source_location"
_FLAT = r"regexp_replace(regexp_replace(content, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(rf"""{_CITED}, b AS (
  SELECT 'answer' AS kind, qid, rank, {_HEAD} || chr(10) || CASE WHEN length(content) > 1600 THEN substr(content, 1, 1600) || chr(10) || '...[chunk truncated]' ELSE content END || chr(10) AS block FROM s
  UNION ALL SELECT 'planner', qid, rank, {_HEAD} || ' (relevance 1.00)' || chr(10) || '    ' || CASE WHEN length({_FLAT}) > 320 THEN substr({_FLAT}, 1, 320) || ' …' ELSE {_FLAT} END || chr(10) FROM s),
c AS (SELECT *, CAST(sum(length(block)) OVER (PARTITION BY kind, qid ORDER BY rank) AS BIGINT) AS chars FROM b)
SELECT kind, qid, CAST(rank AS INTEGER) AS number, sha256(block) AS block_sha256, chars FROM c WHERE chars <= CASE kind WHEN 'answer' THEN {X.ANSWER_CHARS} ELSE {X.PLANNER_CHARS} END""")
def prompt_evidence(spark, sf_dir):
    """The blocks of the twenty best documents of each benchmark item that fit the prompt of an answer and of a planner."""
    index = _index(spark, sf_dir)
    found = R.with_chunks(R.search(index, C.benchmark_queries(spark, sf_dir), "BM25", 20, explain=False), index, "source_location", "content")
    cited = stored(found.select("qid", F.col("rank").cast("int").alias("number"), "path", "source_location", F.lit(1.0).alias("score"), "content"))
    parts = [X.evidence(cited, planner).select(F.lit(kind).alias("kind"), "qid", "number", F.sha2("block", 256).alias("block_sha256"), "chars") for kind, planner in (("answer", False), ("planner", True))]
    return parts[0].unionByName(parts[1])


@query()
def iterative_citations(spark, sf_dir):
    """Citations of each benchmark item after a planned second search with the second half of its words (J10, D7, D8, F9, H3). A loop: no SQL."""
    _, search = _over_chunks(spark, sf_dir)

    def of_queries(due):
        named = stored(due.withColumn("sid", F.xxhash64("qid", "search")))
        return search(named.select(F.col("sid").alias("qid"), "query"), 8).withColumnRenamed("qid", "sid").join(named.select("sid", "qid", "search"), "sid")

    def plan(held, attempts):
        words = F.split("query", " ")
        half = F.array_join(F.slice(words, F.size(words) / 2 + 1, F.size(words)), " ")
        return attempts.select("qid", F.lit("SEARCH").alias("action"), F.array(half, F.col("query")).alias("queries"))

    # this planner is made of columns, so that it is never away: a failure is raised
    return I.collect(C.benchmark_queries(spark, sf_dir), of_queries, plan).drop("planner_unavailable").withColumn("score", F.round("score", 6))


@query()
def semantic_highlights(spark, sf_dir):
    """Best spans and literal terms of each benchmark item in its ten best chunks (J12, G5, I26, C4, J25). A greedy choice among embedded spans: no SQL."""
    index, search = _over_chunks(spark, sf_dir)
    asked = C.benchmark_queries(spark, sf_dir)
    best = G.highlights(search(asked, 10).join(asked, "qid"))
    return best.select("qid", "chunk_id", F.size("spans").alias("spans"), F.size("terms").alias("terms"), F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("places"))


@query()
def html_main_text(spark, sf_dir):
    """Main text of every page, by section (A14). HTML needs a parser: no SQL."""
    return H.sections(C.table(spark, sf_dir, "pages")).select("page_id", "section", "title", "number", "text")


# files

_FILES = """files AS (SELECT source AS root, CAST(doc_id AS VARCHAR) || '.' || lang AS relative_path, lang AS extension, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, doc_id * 1000 AS modified_at, sha256(coalesce(text, '')) AS content_hash, n_chars FROM documents)"""
_ENTRIES = """entries AS (SELECT root, relative_path || CASE WHEN doc_id % 13 = 0 THEN '.old' ELSE '' END AS relative_path, size, modified_at, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE content_hash END AS content_hash,
  CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 2 END AS reader_version FROM files WHERE doc_id % 7 <> 0)"""


def _files(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = C.table(spark, sf_dir, "documents").select(F.col("source").alias("root"), F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang").alias("relative_path"), F.col("lang").alias("extension"), "doc_id", F.octet_length(text).cast("long").alias("size"), (F.col("doc_id") * 1000).alias("modified_at"), text.alias("content"), "n_chars")
    return P.fingerprints(docs)


def _entries(files):
    """A past state of the files: some were absent, named otherwise, other in content or read by an older reader."""
    past = lambda k: F.col("doc_id") % k == 0
    return files.where("doc_id % 7 <> 0").select("root", F.concat("relative_path", F.when(past(13), ".old").otherwise("")).alias("relative_path"), "size", "modified_at", F.when(past(11), "other").otherwise(F.col("content_hash")).alias("content_hash"), F.lit("text").alias("reader_id"), F.when(past(17), 1).otherwise(2).alias("reader_version"), F.lit(3).alias("chunking_version"))


@query(f"""WITH {_FILES}, {_ENTRIES} SELECT coalesce(f.root, e.root) AS root, coalesce(f.relative_path, e.relative_path) AS relative_path,
  CASE WHEN e.root IS NULL THEN 'added' WHEN f.root IS NULL THEN 'deleted' WHEN f.size = e.size AND f.modified_at = e.modified_at AND f.content_hash = e.content_hash AND e.reader_version = 2 THEN 'reused' ELSE 'modified' END AS action
  FROM files f FULL OUTER JOIN entries e ON f.root = e.root AND f.relative_path = e.relative_path""")
def incremental_plan(spark, sf_dir):
    """What to read again, keep or drop since a past state of the documents."""
    files = _files(spark, sf_dir)
    return P.plan(_entries(files), files.withColumns({"reader_id": F.lit("text"), "reader_version": F.lit(2)}), 3)


@query(f"""WITH {_FILES}, h AS (SELECT root, sha256(relative_path || chr(0) || size || chr(0) || modified_at) AS h FROM files),
b AS (SELECT root, substr(h, 1, 3) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY ALL)
SELECT root, CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(h, '' ORDER BY b)) AS set_hash FROM b GROUP BY root""")
def source_set_hash(spark, sf_dir):
    """One hash of the files of each root."""
    return P.set_hash(_files(spark, sf_dir), "root")


@query(f"""WITH {_FILES}, c AS (SELECT extension, count(*) AS n FROM files WHERE extension NOT IN ('en') GROUP BY extension), t AS (SELECT * FROM c ORDER BY n DESC, extension LIMIT 6)
SELECT (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM c) AS skipped, string_agg(extension || ' ' || n, ', ' ORDER BY n DESC, extension) AS listed FROM t""")
def unsupported_rollup(spark, sf_dir):
    """Files that no reader takes, were English the only one."""
    return P.unsupported(_files(spark, sf_dir), ["en"])


@query(f"""WITH {_FILES}, {_ENTRIES} SELECT coalesce(f.relative_path, e.relative_path) AS relative_path, coalesce(f.root, e.root) AS root,
  CASE WHEN f.root IS NULL THEN 'DELETED' WHEN f.doc_id % 19 = 0 THEN 'IGNORED' WHEN f.extension = 'fr' THEN 'UNSUPPORTED' WHEN f.size > 2000 THEN 'OVERSIZED' WHEN e.root IS NULL THEN 'NOT_INDEXED' WHEN f.content_hash = e.content_hash THEN 'INDEXED' ELSE 'MODIFIED' END AS state
  FROM files f FULL OUTER JOIN entries e ON f.root = e.root AND f.relative_path = e.relative_path""")
def file_state(spark, sf_dir):
    """The state of each file against the index."""
    files = _files(spark, sf_dir)
    old = _entries(files).select("root", "relative_path", F.col("content_hash").alias("old_hash"))
    rows = files.join(old, ["root", "relative_path"], "full_outer")
    there = F.col("doc_id").isNotNull()
    state = P.file_state(F.col("doc_id") % 19 == 0, F.col("extension") != "fr", F.col("size") > 2000, F.col("old_hash").isNotNull(), there, F.col("old_hash") == F.col("content_hash"))
    return rows.select("relative_path", "root", state.alias("state"))


@query(f"WITH {O.DOCS}, a AS (SELECT unnest(['/kb', '/kb/' || string_split(path, '/')[3]]) AS folder FROM docs) SELECT folder, count(*) AS n FROM a GROUP BY folder")
def descendant_counts(spark, sf_dir):
    """Files below each folder."""
    return P.descendants(C.whole_documents(spark, sf_dir))


# control tables


@query("""WITH d AS (SELECT '/kb/' || source || '/' || doc_id || '.' || lang AS path FROM documents), r AS (SELECT '/kb' AS root UNION ALL SELECT DISTINCT '/kb/' || source FROM documents WHERE source < 'm')
SELECT path, max_by(root, length(root)) AS owner FROM d JOIN r ON starts_with(path, root || '/') GROUP BY path""")
def owner_root(spark, sf_dir):
    """The innermost root of each path."""
    docs = C.whole_documents(spark, sf_dir).select("path")
    roots = C.table(spark, sf_dir, "documents").where("source < 'm'").select(F.concat(F.lit("/kb/"), "source").alias("root")).unionByName(spark.range(1).select(F.lit("/kb").alias("root")))
    return N.owner_root(docs, roots).select("path", "owner")


@query("""WITH a AS (SELECT DISTINCT lang || '/' || source AS source FROM documents WHERE doc_id % 3 = 0), b AS (SELECT DISTINCT lang || '/' || source AS source FROM documents WHERE n_chars > 15000)
SELECT source, 'add' AS action FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT source, 'remove' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def source_sync(spark, sf_dir):
    """Sources to add and to remove between two sets of them (H4)."""
    docs = C.table(spark, sf_dir, "documents").withColumn("source", F.concat("lang", F.lit("/"), "source"))
    return N.source_sync(docs.where("doc_id % 3 = 0"), docs.where("n_chars > 15000"))


@query(f"SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= {N.KEPT_EVENTS}")
def latest_events(spark, sf_dir):
    """The newest events of each type, as a ring buffer keeps them."""
    return N.newest(C.table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id")


@query("SELECT user_id, round(sum(CASE WHEN event_id % 4 > 0 THEN value END), 6) AS prompt, round(sum(CASE WHEN event_id % 4 > 1 THEN value END), 6) AS completion FROM events GROUP BY user_id")
def token_usage(spark, sf_dir):
    """Usage of each user, in part unknown."""
    usage = C.table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("prompt"), F.when(F.col("event_id") % 4 > 1, F.col("value")).alias("completion"))
    return N.usage_total(usage, "user_id").select("user_id", F.round("prompt", 6).alias("prompt"), F.round("completion", 6).alias("completion"))


@query("""WITH r AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'Sure: {"action":"search","queries":["one ' || item_id || '"," ","two"]} done' WHEN 1 THEN '{"action":"answer"}' WHEN 2 THEN 'no json' WHEN 3 THEN '{"action":"search","query":"q' || item_id || '"}' ELSE '{"action":"search","queries":[]}' END AS reply FROM benchmark)
SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'SEARCH' WHEN 1 THEN 'ANSWER' WHEN 3 THEN 'SEARCH' ELSE 'UNAVAILABLE' END AS action, CASE item_id % 5 WHEN 0 THEN 'one ' || item_id || '|two' WHEN 3 THEN json_extract_string(reply, '$.query') ELSE '' END AS queries FROM r""")
def planner_decisions(spark, sf_dir):
    """Replies of a planner read as decisions."""
    n = F.col("item_id")
    reply = F.when(n % 5 == 0, F.concat(F.lit('Sure: {"action":"search","queries":["one '), n, F.lit('"," ","two"]} done'))).when(n % 5 == 1, '{"action":"answer"}').when(n % 5 == 2, "no json").when(n % 5 == 3, F.concat(F.lit('{"action":"search","query":"q'), n, F.lit('"}'))).otherwise('{"action":"search","queries":[]}')
    got = C.table(spark, sf_dir, "benchmark").select("item_id", I.decision(reply).alias("d"))
    return got.select("item_id", "d.action", F.array_join("d.queries", "|").alias("queries"))


@query("""WITH e AS (SELECT DISTINCT '/kb' AS folder, source AS name, true AS is_folder FROM documents UNION ALL SELECT '/kb', 'n' || doc_id || '.' || upper(lang), false FROM documents)
SELECT folder, name, CAST(row_number() OVER (PARTITION BY folder ORDER BY is_folder DESC, lower(name), name) AS INTEGER) AS position FROM e""")
def folder_listing(spark, sf_dir):
    """Folders first, then files, by name."""
    docs = C.table(spark, sf_dir, "documents")
    entries = docs.select(F.lit("/kb").alias("folder"), F.col("source").alias("name"), F.lit(True).alias("is_folder")).distinct().unionByName(docs.select(F.lit("/kb").alias("folder"), F.concat(F.lit("n"), F.col("doc_id"), F.lit("."), F.upper("lang")).alias("name"), F.lit(False).alias("is_folder")))
    return N.listed(entries).select("folder", "name", "position")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS number FROM documents),
c AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY number) AS chars FROM l WHERE number <= {N.PREVIEW_LINES}) SELECT doc_id, CAST(number AS INTEGER) AS number, line FROM c WHERE chars <= {N.PREVIEW_CHARS}""")
def file_preview(spark, sf_dir):
    """The lines that a preview of each document shows."""
    return N.preview(C.table(spark, sf_dir, "documents"))


@query()
def freshness_state(spark, sf_dir):
    """Events of each user as changes of a knowledge base, folded into its freshness (L2-L8). A state machine: no SQL."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("start", "touched", "reconciled", "modify", "overflow", "touched", "stop")]), (F.col("event_id") % 7 + 1).cast("int"))
    events = C.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("kb"), F.floor(F.col("event_id") / 2000).alias("epoch"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kinds.alias("kind"), F.lit("h").alias("hash"), F.lit(None).cast("long").alias("base"))
    return W.replayed(events)


# conversations

_TOKENS = f"CASE WHEN coalesce(text, '') IS NULL THEN 0 ELSE CAST(ceil(ceil({_wide(chr(99))} + (length(c) - {_wide(chr(99))}) / 4) + 4) AS BIGINT) END"


@query(f"SELECT conv_id, turn, {_TOKENS} AS tokens FROM (SELECT *, coalesce(text, '') AS c FROM conversations)")
def token_estimate(spark, sf_dir):
    """Estimated tokens of every message."""
    return C.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.message_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH m AS (SELECT *, coalesce(text, '') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations),
t AS (SELECT *, {_TOKENS} AS tokens FROM m WHERE age <= {V.MESSAGES}), h AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY age) AS held FROM t),
f AS (SELECT *, min(turn) FILTER (role = 'user' AND (held <= {V.BUDGET} OR age = 1)) OVER (PARTITION BY conv_id) AS first FROM h)
SELECT conv_id, turn, role, tokens, CAST(held AS BIGINT) AS held FROM f WHERE turn >= first""")
def conversation_trim(spark, sf_dir):
    """The history that goes with the next question."""
    return V.trimmed(C.table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "tokens", "held")


@query(rf"""WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user'), b AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM u)
SELECT conv_id, turn, before, CASE WHEN before IS NOT NULL AND (length(text) <= {V.SHORT} OR regexp_matches(text, {O.quote(V.PRONOUN)})) THEN substr(before || chr(10) || text, 1, {V.RESOLVED}) ELSE text END AS resolved FROM b""")
def last_user_turn(spark, sf_dir):
    """Each question with the one before where it points back."""
    return V.resolved(C.table(spark, sf_dir, "conversations")).select("conv_id", "turn", "before", "resolved")


@query(f"""WITH c AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq FROM conversations),
r AS (SELECT *, count(*) FILTER (role = 'system') OVER w AS revision, max(CASE WHEN role = 'user' THEN seq END) OVER w AS request FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY seq)),
b AS (SELECT *, role = 'user' AND lag(revision) OVER (PARTITION BY conv_id, role ORDER BY seq) IS DISTINCT FROM revision AS new FROM r WHERE role IN ('user', 'assistant')),
s AS (SELECT *, CAST(count(*) FILTER (new) OVER (PARTITION BY conv_id ORDER BY seq) AS BIGINT) AS session, role = 'assistant' AND request IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, request, role ORDER BY seq) = 1 AS done FROM b),
x AS (SELECT a.conv_id, a.session, a.seq, length(u.text) + length(a.text) AS chars FROM s a JOIN s u ON u.conv_id = a.conv_id AND u.seq = a.request WHERE a.done),
h AS (SELECT u.conv_id, u.seq, chars, row_number() OVER (PARTITION BY u.conv_id, u.seq ORDER BY x.seq DESC) AS age FROM s u JOIN x ON x.conv_id = u.conv_id AND x.session = u.session AND x.seq < u.seq WHERE u.role = 'user'),
t AS (SELECT conv_id, seq, 2 * count(*) AS n, sum(chars) AS chars FROM h WHERE age <= {V.MESSAGES // 2} GROUP BY conv_id, seq)
SELECT s.conv_id, s.seq, session, CASE WHEN new THEN 'opened' WHEN role = 'user' THEN 'continued' WHEN done THEN 'committed' ELSE 'discarded' END AS outcome,
  CAST(CASE WHEN role = 'user' THEN coalesce(n, 0) END AS BIGINT) AS history_messages, CAST(CASE WHEN role = 'user' THEN coalesce(t.chars, 0) END AS BIGINT) AS history_chars FROM s LEFT JOIN t ON t.conv_id = s.conv_id AND t.seq = s.seq""")
def conversation_sessions(spark, sf_dir):
    """What each message does to its conversation's session: a user's asks, the first assistant's after it answers, a system's begins another revision."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = C.table(spark, sf_dir, "conversations").withColumn("seq", F.row_number().over(order).cast("long"))
    asked = F.last(F.when(F.col("role") == "user", F.col("seq")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("revision", F.count(F.when(F.col("role") == "system", 1)).over(so_far)).withColumn("request", asked.cast("string"))
    kind = F.when(F.col("role") == "user", "ask").when(F.col("role") == "assistant", "answer")
    events = rows.select(F.col("conv_id").cast("string").alias("kb"), "seq", F.timestamp_seconds("seq").alias("ts"), "revision", kind.alias("kind"), "request", "text")
    told = F.when(F.col("kind") == "ask", F.size("history")).cast("long")
    chars = F.aggregate("history", F.lit(0).cast("long"), lambda n, m: n + F.length(m["text"]))
    return SS.replayed(events).select(F.col("kb").try_cast("long").alias("conv_id"), "seq", "session", "outcome", told.alias("history_messages"), chars.alias("history_chars"))


# events

_RATIO = f"least({V.HIGH}, greatest({V.LOW}, value / (40 + event_id % 60)))"


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(1 AS DOUBLE) AS factor FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.r, e.event_id, CASE WHEN 40 + e.event_id % 60 >= {V.LEAST_TOKENS} AND e.value IS NOT NULL THEN least({V.HIGH}, greatest({V.LOW}, {V.KEEP} * f.factor + {1 - V.KEEP} * {_RATIO.replace('event_id', 'e.event_id').replace('value', 'e.value')})) ELSE f.factor END
  FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, event_id, round(factor, 6) AS factor FROM f WHERE r > 0""")
def usage_ewma(spark, sf_dir):
    """Calibration factor of each user after each observation."""
    usage = C.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (40 + F.col("event_id") % 60).alias("estimate"), F.col("value").alias("actual"))
    return V.calibrated(usage).select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), F.round("factor", 6).alias("factor"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    """Bursts of events: a pause of ten minutes ends one (L2)."""
    events = C.table(spark, sf_dir, "events")
    return events.groupBy("user_id", F.session_window("ts", "10 minutes").alias("s")).agg(F.min("ts").alias("start"), F.count("*").alias("n")).select("user_id", "start", "n")


@query(r"""SELECT event_id, substr(regexp_replace(regexp_replace(props, '(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+', '\1[REDACTED]', 'g'), '(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*"?)[^\s,;"]+', '\1[REDACTED]', 'g'), 1, 500) AS props FROM events""")
def redact_events(spark, sf_dir):
    """Properties of events without keys."""
    return C.table(spark, sf_dir, "events").select("event_id", T.redact(F.col("props")).alias("props"))


@query("SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles."""
    return E.nearest_rank(C.table(spark, sf_dir, "events"), "event_type", "value", (50, 95))


# evaluation

_LIMIT = 12
_METRICS = f"""o AS (SELECT qid, file_name, row_number() OVER (PARTITION BY qid ORDER BY rnk) AS pos FROM res WHERE rnk <= {_LIMIT}),
ex AS (SELECT qid, file_name FROM sparse WHERE rank <= 3), n AS (SELECT qid, count(*) AS want FROM ex GROUP BY qid),
r AS (SELECT qid, count(*) AS got FROM o GROUP BY qid),
m AS (SELECT n.qid, 'c' || (n.qid % 3) AS category, want, coalesce(got, 0) AS got, count(o.pos) FILTER (o.pos <= 5) AS h5, min(o.pos) FILTER (o.pos <= 10) AS best,
    coalesce(sum(ln(2) / ln(o.pos + 1)) FILTER (o.pos <= 10), 0) AS dcg FROM n LEFT JOIN r USING (qid) JOIN ex USING (qid) LEFT JOIN o ON o.qid = ex.qid AND o.file_name = ex.file_name GROUP BY n.qid, want, got),
per_case AS (SELECT qid, category, h5 / want AS recall5, CASE WHEN h5 > 0 THEN 1.0 ELSE 0.0 END AS hit5, CASE WHEN got > 0 THEN h5 / least(5, got) ELSE 0 END AS precision5, coalesce(1.0 / best, 0) AS mrr10,
    least(1.0, dcg / (SELECT sum(ln(2) / ln(k + 1)) FROM range(1, 4) t(k) WHERE k <= want)) AS ndcg10 FROM m)"""
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in E.MEANS)
_OF_RRF = f"{_HYBRID}, {O.pool(_LIMIT)}, f2 AS (SELECT *, fusion AS score FROM pool), {O.capped('f2', 'score', _LIMIT, 'file_name, seq')}"
_OF_RERANK = f"{_HYBRID}, {O.pool(_LIMIT)}, {O.FEATURES}, {O.RERANKED}, {O.capped('fin', 'score', _LIMIT, 'file_name, source_location, chunk_id')}"


def _asked(spark, sf_dir):
    """The index, the analysed items and both branches, which all strategies share."""
    index, queries = _index(spark, sf_dir), L.analysed(C.benchmark_queries(spark, sf_dir))
    return index, queries, R.branches(index, queries, max(4 * _LIMIT, R.BRANCH))


def _metrics(index, queries, found_by, strategy):
    """Metrics against the three best lexical results of each item: how far a strategy keeps them."""
    best = found_by[0].where("rank <= 3")
    none = F.array().cast("array<string>")
    cases = best.groupBy("qid").agg(F.collect_list("file_name").alias("expected")).select("qid", "expected", F.concat(F.lit("c"), F.col("qid") % 3).alias("category"), F.lit(False).alias("passage"), none.alias("forbidden"), none.alias("hard"), F.lit(True).alias("answerable"))
    found = R.search(index, queries, strategy, _LIMIT, explain=False, found_by=found_by).select("qid", "rank", "file_name", F.lit(False).alias("passage_hit"))
    return E.per_case(found, cases)


@query(f"{_OF_RERANK}, {_METRICS} SELECT qid, {', '.join(f'round({m}, 6) AS {m}' for m in E.MEANS)} FROM per_case")
def eval_metrics(spark, sf_dir):
    """Metrics of each benchmark item (2.K, D12, F4, F5, I30)."""
    return _metrics(*_asked(spark, sf_dir), "RRF_RERANK").select("qid", *[F.round(m, 6).alias(m) for m in E.MEANS])


@query(f"{_OF_RERANK}, {_METRICS} SELECT category, count(*) AS cases, {_MEANS} FROM per_case GROUP BY category")
def eval_by_category(spark, sf_dir):
    """Their means for each category."""
    return E.rollup(_metrics(*_asked(spark, sf_dir), "RRF_RERANK"), "category")


_OF = {
    "BM25": f"{_HYBRID}, res AS (SELECT qid, file_name, rank AS rnk FROM sparse)",
    "DENSE": f"{_HYBRID}, res AS (SELECT qid, file_name, rank AS rnk FROM dense JOIN docs USING (chunk_id))",
    "RRF": _OF_RRF,
    "RRF_RERANK": _OF_RERANK,
}


@query(" UNION ALL ".join(f"SELECT '{s}' AS strategy, * FROM ({sql}, {_METRICS} SELECT count(*) AS cases, {_MEANS} FROM per_case)" for s, sql in _OF.items()))
def eval_ablation(spark, sf_dir):
    """Their means for each of the four strategies."""
    asked = _asked(spark, sf_dir)
    parts = [E.rollup(_metrics(*asked, s)).withColumn("strategy", F.lit(s)) for s in R.STRATEGIES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_WORDS = "regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"
_JOINED = "' ' || array_to_string({x}, ' ') || ' '"
_GRADES = f"""dw AS (SELECT doc_id || '.' || lang AS file_name, {_JOINED.format(x=_WORDS.format(x='text'))} AS t FROM documents), iw AS (SELECT item_id AS qid, {_WORDS.format(x='text')} AS w FROM benchmark),
gr AS (SELECT qid, file_name, CASE WHEN contains(t, {_JOINED.format(x='w')}) THEN 2 ELSE 1 END AS grade FROM iw JOIN dw ON contains(t, {_JOINED.format(x=f'w[1:{E.ANCHOR}]')}) WHERE len(w) > 0)"""


@query(f"WITH {_GRADES} SELECT qid, file_name, CAST(grade AS INTEGER) AS grade FROM gr")
def passage_grades(spark, sf_dir):
    """Where the benchmark's passages stand: relevance 2 for the whole, 1 for the beginning."""
    return E.grades(C.whole_documents(spark, sf_dir), C.benchmark_queries(spark, sf_dir).withColumnRenamed("query", "passage"))


_TOXIC = "tox AS (SELECT DISTINCT d.doc_id || '.' || lang AS file_name FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1)"
_RELEVANT = f"""{_HYBRID}, {_GRADES}, {_TOXIC}, u AS (SELECT qid, file_name, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS pos FROM sparse WHERE rank <= 20),
near AS (SELECT s.qid, s.file_name FROM sparse s ANTI JOIN gr ON gr.qid = s.qid AND gr.file_name = s.file_name WHERE rank <= 20 AND rank > 10),
e AS (SELECT i.qid, count(g.file_name) AS want, coalesce(max(grade), 0) = 2 AS passage FROM iw i LEFT JOIN gr g USING (qid) WHERE i.qid IN (SELECT qid FROM qs) GROUP BY i.qid),
h AS (SELECT u.qid, u.pos, grade, t.file_name IS NOT NULL AS toxic, n.file_name IS NOT NULL AS hard FROM u LEFT JOIN gr USING (qid, file_name) LEFT JOIN tox t USING (file_name) LEFT JOIN near n ON n.qid = u.qid AND n.file_name = u.file_name),
a AS (SELECT e.qid, want, passage, count(h.pos) AS n, count(grade) FILTER (pos <= 5) AS h5, count(grade) FILTER (pos <= 20) AS h20, min(pos) FILTER (grade IS NOT NULL) AS best, min(pos) FILTER (hard) AS worst,
    coalesce(bool_or(toxic AND pos <= 10), false) AS forbidden_hit, coalesce(sum((pow(2, grade) - 1) * ln(2) / ln(pos + 1)) FILTER (pos <= 10), 0) AS dcg FROM e LEFT JOIN h USING (qid) GROUP BY e.qid, want, passage),
m AS (SELECT *, (SELECT sum((pow(2, CASE WHEN k = 1 AND passage THEN 2 ELSE 1 END) - 1) * ln(2) / ln(k + 1)) FROM range(1, 11) t(k) WHERE k <= greatest(1, want)) AS ideal, CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END AS quiet FROM a)"""


@query(f"""WITH {_RELEVANT.removeprefix('WITH ')} SELECT qid, CASE WHEN want > 0 THEN 'planted' ELSE 'absent' END AS category, round(CASE WHEN want > 0 THEN h5 / want ELSE quiet END, 6) AS recall5, round(CASE WHEN want > 0 THEN h20 / want ELSE quiet END, 6) AS recall20,
  round(CASE WHEN want > 0 THEN CASE WHEN h5 > 0 THEN 1.0 ELSE 0.0 END ELSE quiet END, 6) AS hit5, round(CASE WHEN want > 0 THEN CASE WHEN n > 0 THEN h5 / least(5, n) ELSE 0 END ELSE quiet END, 6) AS precision5,
  round(CASE WHEN want > 0 AND best <= 10 THEN 1.0 / best ELSE 0 END, 6) AS mrr10, round(CASE WHEN want > 0 THEN least(1.0, dcg / ideal) ELSE quiet END, 6) AS ndcg10, forbidden_hit, worst IS NOT NULL AND (best IS NULL OR worst < best) AS outranked FROM m""")
def eval_relevance(spark, sf_dir):
    """Metrics of the lexical search against where the passages really stand: grades 2 and 1, items that stand nowhere, toxic documents as forbidden ones, near misses as hard negatives (A23, D12, F4, I30, 2.K)."""
    index, queries = _index(spark, sf_dir), C.benchmark_queries(spark, sf_dir)
    hits = stored(R.search(index, queries, "BM25", 20, explain=False).select("qid", "rank", "file_name"))
    grades = stored(passage_grades(spark, sf_dir))
    toxic = C.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().join(C.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang").alias("file_name")), "doc_id").select("file_name")
    listed = lambda rows, name: rows.groupBy("qid").agg(F.collect_set("file_name").alias(name))
    near = hits.where("rank > 10").join(grades, ["qid", "file_name"], "left_anti")
    cases = L.analysed(queries).select("qid").join(grades.groupBy("qid").agg(F.collect_set("file_name").alias("expected"), (F.max("grade") == 2).alias("passage")), "qid", "left")
    cases = cases.join(listed(hits.join(toxic, "file_name", "left_semi"), "forbidden"), "qid", "left").join(listed(near, "hard"), "qid", "left")
    none = F.array().cast("array<string>")
    cases = cases.select("qid", *[F.coalesce(c, none).alias(c) for c in ("expected", "forbidden", "hard")], F.coalesce("passage", F.lit(False)).alias("passage"), F.col("expected").isNotNull().alias("answerable"))
    cases = cases.withColumn("category", F.when(F.col("answerable"), "planted").otherwise("absent"))
    graded = hits.join(grades, ["qid", "file_name"], "left").select("qid", "rank", "file_name", F.coalesce(F.col("grade") == 2, F.lit(False)).alias("passage_hit"))
    found = E.per_case(graded, cases)
    return found.select("qid", "category", *[F.round(m, 6).alias(m) for m in E.ALL_MEANS], "forbidden_hit", "outranked")
