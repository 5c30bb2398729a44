"""Query keys of embedding, search and question preparation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import grading as G
from ledgerloom.operators import retrieval as R
from ledgerloom.operators import vectors as V
from ledgerloom.operators.chunking import chunk_files
from ledgerloom.plans.corpus import LIBRARY, packed_sql
from ledgerloom.plans.registry import query
from ledgerloom.plans.text_plans import WS, duck_strip
from ledgerloom.plans.views import DEADLINES, MESSAGES, PROBES, VECTORS, with_
from ledgerloom.sources.tables import corpus_files, deadlines, grade_items, messages, probes, vectors

VP = (VECTORS, PROBES)
FLOOR, SOFT, TOP, BUDGET = 0.42, 0.2, 6, 1500

# ------------------------------------------------------------------ embedding

def word_rows(key: str, src: str) -> str:
    return f"""word_rows AS (SELECT {key}, w FROM (SELECT {key}, regexp_replace(regexp_replace(x, '^[.,!?:;()\\[\\]"'']+', ''), '[.,!?:;()\\[\\]"'']+$', '') AS w
  FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '{WS}+')) AS x FROM {src})) WHERE w <> ''),
counts AS (SELECT {key}, ('0x' || right(md5(w), 3))::INT % 512 AS bucket, count(*) AS n FROM word_rows GROUP BY ALL),
embedded AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM counts)"""


DOC_WORDS = word_rows("doc_id", "documents")


@query("hashed_embed", with_(DOC_WORDS) + "SELECT doc_id, bucket, round(weight, 6) AS weight FROM embedded")
def hashed_embed(t):
    return V.hashed_embedding(t.documents, "doc_id").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query(
    "embed_with",
    with_(DOC_WORDS) + "SELECT doc_id, count(*)::INT AS filled, round(max(weight), 6) AS largest FROM embedded GROUP BY doc_id",
)
def embed_with(t):
    """The pluggable embedder with its default model, summed up per document."""
    return V.embed_with(t.documents.select("doc_id", "text")).selectExpr(
        "doc_id", "size(filter(embedding, x -> x > 0)) AS filled", "round(array_max(embedding), 6) AS largest"
    )


@query(
    "hashed_search",
    with_(
        DOC_WORDS,
        word_rows("item_id", "benchmark").replace("word_rows", "q_rows").replace("counts", "q_counts").replace("embedded", "q_embedded"),
    )
    + """SELECT question_id, collection, chunk_id, round(score, 6) AS score, rn FROM (
  SELECT *, (row_number() OVER (PARTITION BY question_id, collection ORDER BY score DESC, chunk_id))::INT AS rn FROM (
    SELECT q.item_id AS question_id, source AS collection, d.doc_id AS chunk_id, round(sum(q.weight * e.weight), 12) AS score
    FROM q_embedded q JOIN embedded e USING (bucket) JOIN documents d ON d.doc_id = e.doc_id GROUP BY ALL) WHERE score >= 0.3) WHERE rn <= 3""",
)
def hashed_search(t):
    """Every benchmark text as a question over every document, best three per source."""
    asked = V.embed_with(t.benchmark.selectExpr("item_id AS question_id", "text")).withColumnRenamed("embedding", "qvec")
    chunks = V.embed_with(t.documents.selectExpr("doc_id AS chunk_id", "source AS collection", "text"))
    return V.top_k(asked, chunks, 3, 0.3).select("question_id", "collection", "chunk_id", F.round("score", 6).alias("score"), "rn")


@query(
    "l2_normalize",
    """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 3)) AS e FROM embeddings),
n AS (SELECT vec_id, e, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12) AS norm FROM v)
SELECT vec_id, round(e[1] / norm, 6) AS first, round(sqrt(list_sum(list_transform(e, lambda x: (x / norm) * (x / norm)))), 6) AS length FROM n""",
)
def l2_normalize(t):
    scaled = t.embeddings.selectExpr("vec_id", "transform(embedding, x -> cast(x AS double) * (1 + vec_id % 3)) AS e")
    return scaled.selectExpr("vec_id", f"{V.l2_normalize('e')} AS u").selectExpr(
        "vec_id", "round(u[0], 6) AS first", "round(sqrt(aggregate(u, 0D, (s, x) -> s + x * x)), 6) AS length"
    )


# ------------------------------------------------------------------ search

SCORED = f"""scored AS (SELECT question_id, collection, chunk_id, round(list_dot_product(q, e), 12) AS score FROM probes, vectors),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY question_id, collection ORDER BY score DESC, chunk_id))::INT AS rn FROM scored),
topk AS (SELECT * FROM ranked WHERE rn <= {TOP} AND score >= {SOFT})"""
TOPK = with_(*VP, SCORED)
HIT_COLS = ["question_id", "collection", "chunk_id"]


def top_hits(t, floor=SOFT):
    return V.top_k(probes(t.embeddings), vectors(t.embeddings), TOP, floor)


def rounded(df, *extra):
    return df.select(*HIT_COLS, F.round("score", 6).alias("score"), *extra)


@query("topk_per_collection", TOPK + "SELECT question_id, collection, chunk_id, round(score, 6) AS score, rn FROM topk")
def topk_per_collection(t):
    return rounded(top_hits(t), "rn")


@query("topk_grid", TOPK + "SELECT question_id, collection, chunk_id, round(score, 6) AS score, rn FROM topk")
def topk_grid(t):
    """The same search in the blocks that serve question tables too large to broadcast at once."""
    return rounded(V.top_k(probes(t.embeddings), vectors(t.embeddings), TOP, SOFT, broadcast_bytes=4096), "rn")


@query(
    "vector_scores",
    with_(*VP) + """SELECT question_id, collection, chunk_id, round(list_dot_product(q, e), 6) AS score FROM probes JOIN vectors ON collection = 'L' || question_id""",
)
def vector_scores(t):
    asked = probes(t.embeddings).withColumn("scope", F.expr("concat('L', question_id)"))
    return rounded(V.scoped_scores(asked, vectors(t.embeddings)))


FLOORED = f"""floored AS (SELECT k.*, best < {FLOOR} AS low_confidence FROM topk k JOIN (SELECT question_id, max(score) AS best FROM topk GROUP BY 1) b
  USING (question_id) WHERE score >= {FLOOR} OR best < {FLOOR})"""


@query("soft_floor", with_(*VP, SCORED, FLOORED) + "SELECT question_id, collection, chunk_id, round(score, 6) AS score, low_confidence FROM floored")
def soft_floor(t):
    return rounded(R.soft_floor(top_hits(t), FLOOR, SOFT), "low_confidence")


LEVELS = """levels AS (SELECT collection, CASE WHEN n % 4 = 0 THEN 'off' WHEN n % 4 = 1 THEN 'explain_only' ELSE 'full' END AS assist_level FROM (
  SELECT CASE WHEN doc_id % 12 < 10 THEN 'L' || (doc_id % 12) ELSE 'X' || (doc_id % 12) END AS collection, (sum(quality) + sum(toxic))::BIGINT AS n FROM labels GROUP BY 1))"""


def levels(t):
    """Access levels of the collections, and of two collections that hold no chunk."""
    named = t.labels.selectExpr("if(doc_id % 12 < 10, concat('L', doc_id % 12), concat('X', doc_id % 12)) AS collection", "quality + toxic AS n")
    return named.groupBy("collection").agg(F.sum("n").alias("n")).selectExpr(
        "collection", "CASE n % 4 WHEN 0 THEN 'off' WHEN 1 THEN 'explain_only' ELSE 'full' END AS assist_level"
    )


@query(
    "gate_resolve",
    with_(*VP, SCORED, FLOORED, LEVELS) + """SELECT question_id, CASE WHEN bool_or(coalesce(assist_level, 'full') = 'off') THEN 'blocked' WHEN bool_or(assist_level = 'explain_only') THEN 'explain_only' ELSE 'full' END AS level,
coalesce(CASE WHEN bool_or(coalesce(assist_level, 'full') = 'off') THEN string_agg(DISTINCT collection, ',' ORDER BY collection) FILTER (assist_level = 'off')
  ELSE string_agg(DISTINCT collection, ',' ORDER BY collection) FILTER (assist_level = 'explain_only') END, '') AS responsible
FROM floored LEFT JOIN levels USING (collection) GROUP BY question_id""",
)
def gate_resolve(t):
    return R.gate(R.soft_floor(top_hits(t), FLOOR, SOFT), levels(t)).selectExpr(
        "question_id", "level", "array_join(responsible, ',') AS responsible"
    )


@query(
    "citations",
    with_(*VP, SCORED, FLOORED) + "SELECT question_id, collection, chunk_id, round(score, 4) AS score, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id))::INT AS n FROM floored",
)
def citations(t):
    return R.citations(R.soft_floor(top_hits(t), FLOOR, SOFT), ["question_id"]).select(*HIT_COLS, F.round("score", 4).alias("score"), "n")


# ------------------------------------------------------------------ budgets over documents

SCORE_OF = "(doc_id * 7919 % 1009) / 1009"
DOC_HITS = f"""doc_hits AS (SELECT doc_id AS chunk_id, lang, source AS collection, {SCORE_OF} AS score, text, greatest(1, length(text) // 4) + 30 AS cost FROM documents)"""


def doc_hits(t, *keys, k):
    """Documents as hits with a made score, best ``k`` of each group."""
    hits = t.documents.selectExpr("doc_id AS chunk_id", "lang", "source AS collection", f"{SCORE_OF} AS score", f"{R.block_cost('text')} AS cost")
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


@query(
    "token_budget",
    with_(DOC_HITS) + """, r AS (SELECT *, row_number() OVER w AS pos, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM doc_hits WINDOW w AS (PARTITION BY collection ORDER BY score DESC, chunk_id))
SELECT collection, chunk_id, pos::INT AS pos FROM r WHERE pos <= 12 AND (pos = 1 OR used <= 3000)""",
)
def token_budget(t):
    return R.budget_prefix(doc_hits(t, "collection", k=12), 3000, ["collection"]).select("collection", "chunk_id", "pos")


@query(
    "token_budget_global",
    "WITH RECURSIVE " + DOC_HITS + """, r AS (SELECT *, row_number() OVER (PARTITION BY lang, collection ORDER BY score DESC, chunk_id) AS depth,
    max(score) OVER (PARTITION BY lang, collection) AS lead FROM doc_hits),
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY depth, lead DESC, collection) AS idx FROM r WHERE depth <= 3),
fold AS (SELECT DISTINCT lang, 0::BIGINT AS idx, 0::BIGINT AS used, 0::BIGINT AS n, NULL::BIGINT AS took FROM i
  UNION ALL SELECT f.lang, i.idx, CASE WHEN f.n > 0 AND f.used + i.cost > 8000 THEN f.used ELSE f.used + i.cost END,
    CASE WHEN f.n > 0 AND f.used + i.cost > 8000 THEN f.n ELSE f.n + 1 END, CASE WHEN f.n > 0 AND f.used + i.cost > 8000 THEN NULL ELSE i.chunk_id END
  FROM fold f JOIN i ON i.lang = f.lang AND i.idx = f.idx + 1)
SELECT f.lang, took AS chunk_id, collection FROM fold f JOIN i ON i.lang = f.lang AND i.chunk_id = f.took""",
)
def token_budget_global(t):
    kept = R.budget_round_robin(doc_hits(t, "lang", "collection", k=3), 8000, ["lang"])
    return kept.select("lang", F.explode("kept").alias("h")).select("lang", "h.chunk_id", "h.collection")


@query(
    "render_context",
    with_(DOC_HITS) + """, r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, chunk_id) AS n FROM doc_hits)
SELECT collection, string_agg('[' || n || '] (collection: ' || collection || ' | source: ' || collection || '/' || chunk_id || '.md | full text)' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS context
FROM r WHERE n <= 4 GROUP BY collection""",
)
def render_context(t):
    """Excerpt block of the best four documents of each source; texts join in after ranking."""
    cited = R.citations(doc_hits(t, "collection", k=4), ["collection"])
    texts = t.documents.selectExpr("doc_id AS chunk_id", "concat('/lib/', source, '/', doc_id, '.md') AS source_path", "'full text' AS locator", "text")
    rows = cited.drop("cost", "lang").join(texts, "chunk_id").withColumn("question_id", F.col("collection"))
    return R.render_context(rows, ["question_id"]).withColumnRenamed("question_id", "collection")


POLICY_TEXT = "CASE doc_id % 3 WHEN 0 THEN ' Quizzes 40 % and the final 60%.' WHEN 1 THEN ' Quizzes 40%.' ELSE '' END"


@query(
    "policy_block",
    f"""WITH h AS (SELECT doc_id, source AS collection, {SCORE_OF} AS score, text || {POLICY_TEXT} AS text FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, doc_id) AS rn FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY rn) AS first FROM r WHERE rn <= 2 AND score >= 0.55 AND len(regexp_extract_all(text, '\\d{{1,3}}{WS}*%')) >= 2)
SELECT collection, '[' || collection || '] doc ' || doc_id || chr(10) || {duck_strip('text')} AS block FROM p WHERE first = 1""",
)
def policy_block(t):
    hits = t.documents.selectExpr(
        "doc_id AS chunk_id", "source AS collection", f"{SCORE_OF} AS score", "concat('doc ', doc_id) AS locator", f"concat(text, {POLICY_TEXT}) AS text"
    )
    return R.policy_block(hits)


@query(
    "calendar_digest",
    with_(DEADLINES) + """, r AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY starts_at, id) AS rn FROM deadlines
  WHERE kind <> 'recurring' AND starts_at::DATE BETWEEN DATE '2024-01-15' AND DATE '2024-01-29')
SELECT course, '(today is 2024-01-15)' || chr(10) || string_agg('- ' || CASE WHEN strftime(starts_at, '%H:%M') = '00:00' THEN strftime(starts_at, '%Y-%m-%d')
  ELSE strftime(starts_at, '%Y-%m-%d %H:%M') END || '  ' || course || ': ' || title || CASE WHEN kind = 'admin' THEN ' [admin]' ELSE '' END, chr(10) ORDER BY rn) AS digest
FROM r WHERE rn <= 60 GROUP BY course""",
)
def calendar_digest(t):
    return R.calendar_digest(deadlines(t.events), "2024-01-15")


@query(
    "calendar_digest_all",
    with_(DEADLINES) + """, r AS (SELECT *, row_number() OVER (ORDER BY starts_at, id) AS rn FROM deadlines
  WHERE kind <> 'recurring' AND starts_at::DATE BETWEEN DATE '2024-01-15' AND DATE '2024-01-29')
SELECT '(today is 2024-01-15)' || chr(10) || string_agg('- ' || CASE WHEN strftime(starts_at, '%H:%M') = '00:00' THEN strftime(starts_at, '%Y-%m-%d')
  ELSE strftime(starts_at, '%Y-%m-%d %H:%M') END || '  ' || course || ': ' || title || CASE WHEN kind = 'admin' THEN ' [admin]' ELSE '' END, chr(10) ORDER BY rn) AS digest
FROM r WHERE rn <= 60 HAVING count(*) > 0""",
)
def calendar_digest_all(t):
    return R.calendar_digest_all(deadlines(t.events), "2024-01-15")


# ------------------------------------------------------------------ conversations

M = with_(MESSAGES)


FOLLOWUPS = f"""u AS (SELECT *, lag(c, 1) OVER w AS p1, lag(c, 2) OVER w AS p2 FROM (
    SELECT *, {duck_strip("regexp_replace(content, '[[][0-9]+]', '', 'g')")} AS c FROM messages WHERE role = 'user' AND content <> '')
  WINDOW w AS (PARTITION BY conversation_id ORDER BY turn))"""
FOLLOWUP_SELECT = """SELECT conversation_id, turn, CASE WHEN greatest(1, length(content) // 4) <= 25 AND p1 IS NOT NULL THEN concat_ws(chr(10), p2, p1, content) ELSE content END AS query FROM u"""


@query("followup_query", M + ", " + FOLLOWUPS + FOLLOWUP_SELECT)
def followup_query(t):
    return R.followup_query(messages(t.conversations))


# Chunk ids are hashes, so equal scores are told apart by rank alone.
@query(
    "corpus_hits",
    packed_sql(
        LIBRARY + ",\n" + MESSAGES + ",\n" + FOLLOWUPS + ", asked AS (" + FOLLOWUP_SELECT.replace("AS query", "AS text") + ")",
        """, pieces AS (SELECT doc_id * 1000 + part AS piece, source, packed.text FROM packed JOIN lib USING (doc_id)), qs AS (SELECT conversation_id * 1000 + turn AS question, text FROM asked), """
        + word_rows("piece", "pieces") + ", " + word_rows("question", "qs").replace("word_rows", "q_rows").replace("counts", "q_counts").replace("embedded", "q_embedded")
        + """ SELECT question AS question_id, source AS collection, rn, round(score, 6) AS score FROM (
  SELECT *, (row_number() OVER (PARTITION BY question, source ORDER BY score DESC))::INT AS rn FROM (
    SELECT question, source, piece, round(sum(q.weight * e.weight), 12) AS score FROM q_embedded q JOIN embedded e USING (bucket) JOIN pieces USING (piece) GROUP BY ALL) WHERE score >= 0.2) WHERE rn <= 2""",
    ),
)
def corpus_hits(t):
    """From files to answers: chunks of the library and their vectors, conversations as questions, the best chunks of each collection."""
    chunks = V.embed_with(chunk_files(corpus_files(t.documents)).select("chunk_id", "collection", "text"))
    asked = R.followup_query(messages(t.conversations)).selectExpr("conversation_id * 1000 + turn AS question_id", "query AS text")
    questions = V.embed_with(asked).withColumnRenamed("embedding", "qvec")
    return V.top_k(questions, chunks, 2, 0.2).select("question_id", "collection", "rn", F.round("score", 6).alias("score"))


@query(
    "history_window",
    M + """, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS rn FROM messages WHERE content <> '')
SELECT conversation_id, turn, role, content FROM (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conversation_id) AS f FROM r WHERE rn <= 5) WHERE turn >= f""",
)
def history_window(t):
    return R.history_window(messages(t.conversations), 5)


TITLE = f"left(replace({duck_strip('content')}, chr(10), ' '), 60)"


@query(
    "conversation_titles",
    M + f"""SELECT conversation_id, coalesce(arg_min({TITLE}, turn) FILTER (role = 'user' AND {TITLE} <> ''), 'New conversation') AS title, max(turn) AS last_turn
FROM messages GROUP BY conversation_id""",
)
def conversation_titles(t):
    return R.conversation_titles(messages(t.conversations))


@query(
    "prompt_history",
    M + f"SELECT conversation_id, turn, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || {duck_strip('content')} AS line FROM messages WHERE {duck_strip('content')} <> ''",
)
def prompt_history(t):
    return R.prompt_history(messages(t.conversations))


# ------------------------------------------------------------------ the whole preparation

def questions(t):
    """Each probe asked three ways: of everything, of its own collection, of a collection without chunks."""
    return probes(t.embeddings).select(
        "question_id", "qvec", F.expr("posexplode(array('all', concat('L', question_id), concat('X', 10 + question_id % 2))) AS (way, scope)")
    ).selectExpr("question_id * 10 + way AS question_id", "scope", "qvec")


def chunk_texts(t):
    return t.embeddings.selectExpr(
        "vec_id AS chunk_id", "concat('lib/L', label, '/', vec_id, '.md') AS source_path", "concat('Section ', vec_id % 9) AS locator",
        "repeat('word ', cast(40 + vec_id * 37 % 600 AS int)) AS text",
    )


def chunk_costs(t):
    return chunk_texts(t).selectExpr("chunk_id", f"{R.block_cost('text')} AS cost")


PREPARED = f"""RECURSIVE {VECTORS}, {PROBES}, {LEVELS},
questions AS (SELECT question_id * 10 AS question_id, 'all' AS scope, q FROM probes UNION ALL SELECT question_id * 10 + 1, 'L' || question_id, q FROM probes
  UNION ALL SELECT question_id * 10 + 2, 'X' || (10 + question_id % 2), q FROM probes),
routed AS (SELECT *, CASE WHEN scope = 'all' THEN 'search' WHEN (SELECT assist_level FROM levels l WHERE l.collection = scope) = 'off' THEN 'blocked'
  WHEN scope NOT IN (SELECT collection FROM vectors) THEN 'empty_index' ELSE 'search' END AS route FROM questions),
sc AS (SELECT question_id, scope, collection, chunk_id, round(list_dot_product(q, e), 12) AS score, (5 * (40 + chunk_id * 37 % 600)) // 4 + 30 AS cost
  FROM routed JOIN vectors ON scope = 'all' OR scope = collection WHERE route = 'search'),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id, collection ORDER BY score DESC, chunk_id) AS depth FROM sc WHERE score >= {SOFT}),
tk AS (SELECT *, max(score) OVER (PARTITION BY question_id, collection) AS lead, max(score) OVER (PARTITION BY question_id) AS best FROM rk WHERE depth <= {TOP}),
hits AS (SELECT t.*, coalesce(assist_level, 'full') AS level FROM tk t LEFT JOIN levels USING (collection) WHERE score >= {FLOOR} OR best < {FLOOR}),
facts AS (SELECT r.question_id, r.scope, r.route, count(h.chunk_id) AS offered, coalesce(bool_or(h.level = 'off'), false) AS has_off, coalesce(bool_or(best < {FLOOR}), false) AS low,
    coalesce(string_agg(DISTINCT h.collection, ', ' ORDER BY h.collection) FILTER (h.level = 'explain_only'), '') AS limited
  FROM routed r LEFT JOIN hits h USING (question_id) GROUP BY ALL),
st AS (SELECT *, CASE WHEN route <> 'search' THEN route WHEN offered = 0 THEN 'no_results' WHEN has_off THEN 'blocked' ELSE 'answerable' END AS status FROM facts),
items AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY depth, lead DESC, collection) AS idx FROM hits),
fold AS (SELECT question_id, scope, 0::BIGINT AS idx, 0::BIGINT AS used, 0 AS n, true AS open, NULL::BIGINT AS took FROM st WHERE status = 'answerable'
  UNION ALL SELECT f.question_id, f.scope, i.idx, CASE WHEN t THEN f.used + i.cost ELSE f.used END, CASE WHEN t THEN f.n + 1 ELSE f.n END,
    f.open AND (t OR f.scope = 'all'), CASE WHEN t THEN i.chunk_id END
  FROM (SELECT f0.*, i0.idx AS nidx, f0.open AND NOT (f0.n > 0 AND f0.used + i0.cost > {BUDGET}) AS t FROM fold f0 JOIN items i0 ON i0.question_id = f0.question_id AND i0.idx = f0.idx + 1) f
  JOIN items i ON i.question_id = f.question_id AND i.idx = f.nidx),
kept AS (SELECT i.*, row_number() OVER (PARTITION BY i.question_id ORDER BY i.score DESC, i.chunk_id) AS n FROM fold f JOIN items i ON i.question_id = f.question_id AND i.chunk_id = f.took),
cited AS (SELECT question_id, count(*) AS n, string_agg(n || ':' || collection || ':' || chunk_id, ',' ORDER BY n) AS cited FROM kept GROUP BY 1),
emp AS (SELECT coalesce(string_agg(collection, ', ' ORDER BY collection), '') AS e FROM levels WHERE collection NOT IN (SELECT collection FROM vectors)),
res AS (SELECT s.question_id, scope, status, CASE WHEN status = 'answerable' THEN CASE WHEN limited <> '' THEN 'explain_only' ELSE 'full' END END AS level,
  CASE WHEN status = 'answerable' THEN limited ELSE '' END AS restricting, coalesce(cited, '') AS cited, CASE WHEN status = 'answerable' THEN offered - n ELSE 0 END AS dropped,
  status = 'answerable' AND low AS low_confidence, CASE WHEN status = 'answerable' AND scope = 'all' THEN (SELECT e FROM emp) ELSE '' END AS empty
  FROM st s LEFT JOIN cited USING (question_id))"""
NOTICES = """concat_ws(' / ', CASE WHEN level = 'explain_only' AND restricting <> '' THEN 'Explain-only: restricted by ' || restricting || ' (assist_level = explain_only). Concepts and practice only.' END,
  CASE WHEN dropped > 0 THEN 'Context truncated: dropped ' || dropped || ' lowest-scoring chunk(s) to fit the token budget.' END,
  CASE WHEN empty <> '' THEN 'Not searched (nothing indexed): ' || empty END,
  CASE WHEN low_confidence THEN 'Weak match: no source scored above the usual relevance floor, so this answer draws on loosely-related excerpts and may be incomplete.' END)"""


def prepared(t):
    return R.prepare_batch(questions(t), vectors(t.embeddings), chunk_costs(t), levels(t), k=TOP, floor=FLOOR, soft=SOFT, budget=BUDGET)


@query(
    "prepare_batch",
    "WITH " + PREPARED + " SELECT question_id, scope, status, level, restricting, cited, dropped::INT AS dropped, low_confidence FROM res",
)
def prepare_batch(t):
    return prepared(t).selectExpr(
        "question_id", "scope", "status", "level", "array_join(restricting, ', ') AS restricting",
        "array_join(transform(cited, c -> concat(c.n, ':', c.collection, ':', c.chunk_id)), ',') AS cited", "dropped", "low_confidence",
    )


ASKING = "CASE question_id % 3 WHEN 0 THEN 'What is due this week?' WHEN 1 THEN 'What do I need on the final?' ELSE 'Explain duration.' END"


def material(t):
    """Texts for the vector questions: a third asks for deadlines, a third for grades."""
    asked = questions(t).selectExpr("question_id", "scope", f"{ASKING} AS text")
    events = deadlines(t.events).withColumn("course", F.expr("replace(course, 'C', 'L')"))
    books = grade_items(t.lineitem).withColumn("course", F.expr("concat('L', cast(substring(course, 2) AS int) % 7)"))
    rules = t.region.selectExpr("concat('L', r_regionkey) AS collection", "concat('[L', r_regionkey, '] Grading\\nExams 60%, homework 40%') AS block")
    return R.question_material(
        asked, R.calendar_digest(events, "2024-01-15"), R.calendar_digest_all(events, "2024-01-15"), G.grades_digest(books), G.grades_digest_all(books), rules
    )


# The digests have oracles of their own; here it counts which of them a question gets.
@query(
    "question_material",
    f"""WITH RECURSIVE {VECTORS}, {PROBES}, q0 AS (SELECT question_id * 10 AS question_id, 'all' AS scope FROM probes UNION ALL SELECT question_id * 10 + 1, 'L' || question_id FROM probes
  UNION ALL SELECT question_id * 10 + 2, 'X' || (10 + question_id % 2) FROM probes), q AS (SELECT *, question_id % 3 = 0 AS s, question_id % 3 = 1 AS g, TRY_CAST(substr(scope, 2) AS INT) AS n FROM q0)
SELECT question_id, CASE WHEN s THEN '(today is 2024-01-15)' WHEN scope = 'all' THEN '- L0: ' ELSE '- ' || scope || ': ' END AS start,
  g AND (scope = 'all' OR (scope LIKE 'L%' AND n < 5)) AS has_policy FROM q WHERE s OR (g AND (scope = 'all' OR (scope LIKE 'L%' AND n < 7)))""",
)
def question_material(t):
    return material(t).selectExpr(
        "question_id", "if(material LIKE '(today%', substring_index(material, '\n', 1), regexp_extract(material, '^- L[0-9]+: ', 0)) AS start",
        "contains(material, 'THE SYLLABUS GRADING POLICY') AS has_policy",
    )


@query(
    "context_only",
    "WITH " + PREPARED + """, q AS (SELECT *, question_id % 3 = 0 OR (question_id % 3 = 1 AND (scope = 'all' OR (scope LIKE 'L%' AND TRY_CAST(substr(scope, 2) AS INT) < 7))) AS has FROM res)
SELECT question_id, CASE WHEN has AND status IN ('no_results', 'empty_index') THEN 'context_only' ELSE status END AS status,
  CASE WHEN has AND status IN ('no_results', 'empty_index') THEN coalesce((SELECT CASE WHEN l.assist_level = 'explain_only' THEN 'explain_only' END FROM levels l WHERE l.collection = q.scope), 'full') ELSE level END AS level,
  cited FROM q""",
)
def context_only(t):
    """Questions that find nothing are answered from calendar and gradebook where their wording asks for these."""
    found = R.prepare_batch(questions(t), vectors(t.embeddings), chunk_costs(t), levels(t), k=TOP, floor=FLOOR, soft=SOFT, budget=BUDGET, material=material(t))
    return found.selectExpr("question_id", "status", "level", "array_join(transform(cited, c -> concat(c.n, ':', c.collection, ':', c.chunk_id)), ',') AS cited")


@query("notices", "WITH " + PREPARED + f" SELECT question_id, {NOTICES} AS notices FROM res")
def notices(t):
    return prepared(t).selectExpr("question_id", "array_join(notices, ' / ') AS notices")


@query(
    "prepared_context",
    "WITH " + PREPARED + """ SELECT question_id, string_agg('[' || n || '] (collection: ' || collection || ' | source: ' || collection || '/' || chunk_id || '.md | Section ' || (chunk_id % 9) || ')'
  || chr(10) || repeat('word ', (40 + chunk_id * 37 % 600)::INT), chr(10) || chr(10) ORDER BY n) AS context FROM kept GROUP BY question_id""",
)
def prepared_context(t):
    return R.contexts(prepared(t), chunk_texts(t))
