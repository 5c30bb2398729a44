"""Query keys of the workload operators."""

from pyspark.sql import functions as F

from ledgerloom.operators import workload as W
from ledgerloom.plans.registry import TABLES, query
from ledgerloom.plans.views import DEADLINES, with_
from ledgerloom.sources.tables import NOW, TERM_END, TERM_START, deadlines

AT = f"TIMESTAMP '{NOW}'"
TODAY = f"DATE '{NOW[:10]}'"
KINDS = "kind IN ('exam', 'project', 'quiz')"
CUTOFF = "CASE WHEN all_day THEN date_trunc('day', starts_at)::TIMESTAMP + to_seconds(86399) ELSE starts_at END"
D = with_(DEADLINES)
RULE_COURSES = "rule_courses AS (SELECT DISTINCT 'C' || (s_suppkey % 15) AS course FROM supplier)"


def rule_courses(t):
    return t.supplier.selectExpr("concat('C', s_suppkey % 15) AS course")


def chunk_lines(t):
    """Every non-blank line of every document as one chunk row."""
    return t.documents.selectExpr(
        "source AS collection", "concat(source, '/', doc_id) AS source_path", "explode(split(text, '\\n')) AS text"
    ).where("trim(text) <> ''")


CHUNK_LINES = """chunk_lines AS (SELECT * FROM (SELECT source AS collection, source || '/' || doc_id AS source_path,
  unnest(string_split(text, chr(10))) AS text FROM documents) WHERE trim(text) <> '')"""


def collections(t):
    return t.nation.selectExpr(
        "concat('src', n_nationkey) AS collection",
        "CASE n_regionkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'explain_only' ELSE 'off' END AS assist_level",
    )


COLLECTIONS = """collections AS (SELECT 'src' || n_nationkey AS collection,
  CASE n_regionkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'explain_only' ELSE 'off' END AS assist_level FROM nation)"""


@query("upcoming_cutoff", D + f"SELECT id, starts_at, all_day, {CUTOFF} AS due_at FROM deadlines")
def upcoming_cutoff(t):
    return W.upcoming_cutoff(deadlines(t.events))


@query(
    "events_between",
    D + """SELECT id, course, title, starts_at, ends_at FROM deadlines
WHERE starts_at < TIMESTAMP '2024-01-12' AND coalesce(ends_at, starts_at) >= TIMESTAMP '2024-01-10'""",
)
def events_between(t):
    return W.events_between(deadlines(t.events), "2024-01-10 00:00:00", "2024-01-12 00:00:00").select(
        "id", "course", "title", "starts_at", "ends_at"
    )


@query(
    "next_events",
    D + f"""SELECT id, course, title, starts_at, kind FROM deadlines WHERE {CUTOFF} >= {AT} AND {KINDS}
ORDER BY starts_at, id LIMIT 8""",
)
def next_events(t):
    return W.next_events(deadlines(t.events), NOW).select("id", "course", "title", "starts_at", "kind")


@query(
    "next_up",
    D + f"""SELECT course, title, starts_at, id, kind, all_day FROM (
  SELECT *, row_number() OVER (PARTITION BY course, title ORDER BY starts_at, id) AS rn
  FROM deadlines WHERE {CUTOFF} >= {AT} AND {KINDS}) WHERE rn = 1 ORDER BY starts_at, id LIMIT 8""",
)
def next_up(t):
    return W.next_up(deadlines(t.events), NOW)


@query(
    "due_within",
    D + f"""SELECT d.days, count(e.id) AS n FROM (VALUES (1), (3), (7), (14)) d(days)
LEFT JOIN (SELECT * FROM deadlines WHERE {CUTOFF} >= {AT} AND {KINDS}) e
  ON e.starts_at < {AT} + to_days(d.days) GROUP BY d.days""",
)
def due_within(t):
    return W.due_within(deadlines(t.events), NOW, [1, 3, 7, 14])


BY_COURSE = f"""per AS (SELECT course, count(*) AS total, count(*) FILTER (starts_at >= {AT}) AS remaining,
    count(*) FILTER (starts_at >= {AT} AND kind = 'exam') AS exam,
    count(*) FILTER (starts_at >= {AT} AND kind = 'quiz') AS quiz,
    count(*) FILTER (starts_at >= {AT} AND kind = 'project') AS project FROM deadlines WHERE {KINDS} GROUP BY course),
firsts AS (SELECT course, title, starts_at, kind FROM (SELECT *, row_number() OVER (PARTITION BY course ORDER BY starts_at, id) AS rn
    FROM deadlines WHERE {KINDS} AND starts_at >= {AT}) WHERE rn = 1),
by_course AS (SELECT coalesce(r.course, p.course) AS course, coalesce(total, 0) AS total, coalesce(remaining, 0) AS remaining,
    coalesce(exam, 0) AS exam, coalesce(quiz, 0) AS quiz, coalesce(project, 0) AS project,
    f.title AS next_title, f.starts_at AS next_at, f.kind AS next_kind, datediff('day', {TODAY}, f.starts_at::DATE) AS days_until_next,
    CASE WHEN coalesce(total, 0) = 0 THEN 'no dated work published' WHEN remaining = 0 THEN 'all deadlines passed' ELSE '' END AS note
  FROM rule_courses r FULL OUTER JOIN per p ON r.course = p.course LEFT JOIN firsts f ON f.course = coalesce(r.course, p.course))"""


@query("by_course", with_(DEADLINES, RULE_COURSES, BY_COURSE) + "SELECT * FROM by_course")
def by_course(t):
    return W.by_course(deadlines(t.events), rule_courses(t), NOW)


@query(
    "by_kind",
    D + f"""SELECT k.kind, count(d.id) AS n FROM (VALUES ('exam'), ('project'), ('quiz')) k(kind)
LEFT JOIN deadlines d ON d.kind = k.kind AND d.starts_at >= {AT} GROUP BY k.kind""",
)
def by_kind(t):
    return W.by_kind(deadlines(t.events), NOW)


@query(
    "daily_load",
    D + f""", per AS (SELECT starts_at::DATE AS date, course, count(*) AS n FROM deadlines
  WHERE {KINDS} AND starts_at >= {AT} AND starts_at < {AT} + to_days(28) GROUP BY ALL)
SELECT s.date, coalesce(sum(n) OVER (PARTITION BY s.date), 0)::BIGINT AS count, course, coalesce(n, 0) AS n
FROM (SELECT ({TODAY} + i::INT)::DATE AS date FROM range(28) r(i)) s LEFT JOIN per p ON p.date = s.date""",
)
def daily_load(t):
    return W.daily_load(deadlines(t.events), NOW)


WEEKS = f"""wk AS (SELECT date_trunc('week', starts_at)::DATE AS week_start, course, count(*) AS n,
    count(*) FILTER (kind <> 'recurring') AS d FROM deadlines WHERE kind <> 'admin' GROUP BY ALL),
spine AS (SELECT unnest(generate_series(least(date_trunc('week', DATE '{TERM_START}'), (SELECT min(week_start) FROM wk)),
    greatest(date_trunc('week', DATE '{TERM_END}'), (SELECT max(week_start) FROM wk)), INTERVAL 7 DAY))::DATE AS week_start),
weeks AS (SELECT s.week_start, coalesce(sum(n), 0)::BIGINT AS count, coalesce(sum(d), 0)::BIGINT AS deadlines
  FROM spine s LEFT JOIN wk USING (week_start) GROUP BY s.week_start)"""


@query("week_load", with_(DEADLINES, WEEKS) + "SELECT week_start, count, deadlines FROM weeks")
def week_load(t):
    return W.week_load(deadlines(t.events), TERM_START, TERM_END)


@query("week_load_by_course", with_(DEADLINES, WEEKS) + "SELECT week_start, count, course, coalesce(n, 0) AS n FROM weeks LEFT JOIN (SELECT week_start, course, n FROM wk) USING (week_start)")
def week_load_by_course(t):
    return W.week_load_by_course(deadlines(t.events), TERM_START, TERM_END)


@query(
    "worst_week",
    with_(DEADLINES, WEEKS) + f"""SELECT week_start, count, deadlines FROM weeks
WHERE week_start >= date_trunc('week', {TODAY}) ORDER BY count DESC, week_start LIMIT 1""",
)
def worst_week(t):
    return W.worst_week(deadlines(t.events), NOW, TERM_START, TERM_END)


@query(
    "week_index",
    with_(DEADLINES, WEEKS) + f"""SELECT week_start, count, (row_number() OVER (ORDER BY week_start))::INT AS week_no,
count(*) OVER () AS weeks, week_start = date_trunc('week', {TODAY}) AS is_current FROM weeks""",
)
def week_index(t):
    return W.week_index(deadlines(t.events), NOW, TERM_START, TERM_END)


@query(
    "busiest_days",
    D + f""", h AS (SELECT *, starts_at::DATE AS date FROM deadlines WHERE {KINDS} AND starts_at >= {AT}),
top AS (SELECT date, count(*) AS count FROM h GROUP BY date ORDER BY count DESC, date LIMIT 5)
SELECT date, count, id, course, title FROM h JOIN top USING (date) WHERE count > 1""",
)
def busiest_days(t):
    return W.busiest_days(deadlines(t.events), NOW)


@query(
    "top_repeat",
    D + f"""SELECT course, title, count(*) AS count FROM deadlines WHERE kind = 'quiz' AND starts_at >= {TODAY}::TIMESTAMP
GROUP BY course, title ORDER BY count DESC, course, title LIMIT 1""",
)
def top_repeat(t):
    return W.top_repeat(deadlines(t.events), NOW)


GRADED = (
    "(?i)\\b(quiz|prueba|test|exam|examen|final|midterm|project|proyecto|paper|essay|presentation|assignment|homework|hw|"
    "tarea|deberes|problem\\s+set|pset|lab|report|draft|discussion|submission|dropbox|activities)\\b"
)


@query(
    "plan_items",
    D + f"""SELECT id, course, title, starts_at, all_day, CASE WHEN starts_at::DATE = {TODAY} THEN 'today' ELSE 'tomorrow' END AS day,
CASE WHEN all_day THEN starts_at::DATE < {TODAY} ELSE starts_at < {AT} END AS past, kind,
kind IN ('exam', 'project') OR (kind = 'quiz' AND regexp_matches(title, '{GRADED}')) AS graded,
coalesce(nullif(regexp_extract(title, 'est\\s+((?:\\d+h\\s*)?\\d+m)', 1), ''), nullif(regexp_extract(title, '\\((\\d+m)\\)', 1), '')) AS estimated
FROM deadlines WHERE kind <> 'recurring' AND starts_at >= {TODAY}::TIMESTAMP AND starts_at <= {TODAY} + INTERVAL 2 DAY - INTERVAL 1 SECOND""",
)
def plan_items(t):
    return W.plan_items(deadlines(t.events), NOW)


@query(
    "plan_capped",
    D + f""", w AS (SELECT id, course, title, starts_at, starts_at::DATE AS date,
    CASE WHEN all_day THEN starts_at::DATE < {TODAY} ELSE starts_at < {AT} END AS past
  FROM deadlines WHERE {KINDS} AND starts_at >= {TODAY}::TIMESTAMP AND starts_at < {TODAY} + INTERVAL 7 DAY),
n AS (SELECT id AS next_id FROM w WHERE NOT past ORDER BY starts_at, id LIMIT 1),
f AS (SELECT w.*, coalesce(id = (SELECT next_id FROM n), false) AS is_next, count(*) OVER (PARTITION BY date) AS due FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY is_next DESC, starts_at, id) AS rn FROM f)
SELECT date, id, course, title, starts_at, is_next, due, greatest(due - 6, 0) AS hidden FROM r WHERE rn <= 6""",
)
def plan_capped(t):
    return W.plan_capped(deadlines(t.events), NOW)


@query(
    "sliding_due",
    D + f""", c AS (SELECT starts_at::DATE AS day, count(*) AS n FROM deadlines WHERE {KINDS} GROUP BY 1)
SELECT (day - i::INT)::DATE AS date, sum(n)::BIGINT AS due FROM c, range(7) r(i) GROUP BY 1""",
)
def sliding_due(t):
    return W.sliding_due(deadlines(t.events))


COMPOSITION = """composition AS (SELECT coalesce(c.collection, k.collection) AS collection, coalesce(assist_level, 'full') AS assist_level,
    coalesce(docs, 0) AS docs, coalesce(chunks, 0) AS chunks,
    round_even(coalesce(chunks, 0) / (SELECT count(*) FROM chunk_lines) * 100, 1) AS share
  FROM collections c FULL OUTER JOIN (SELECT collection, count(*) AS chunks, count(DISTINCT source_path) AS docs
    FROM chunk_lines GROUP BY collection) k ON c.collection = k.collection)"""


@query("index_composition", with_(CHUNK_LINES, COLLECTIONS, COMPOSITION) + "SELECT * FROM composition")
def index_composition(t):
    return W.index_composition(chunk_lines(t), collections(t))


@query(
    "file_types",
    """WITH e AS (SELECT CASE WHEN contains(url, '.') THEN lower(split_part(url, '.', -1)) ELSE '(none)' END AS ext FROM pages)
SELECT ext, count(*) AS chunks, round_even(count(*) / (SELECT count(*) FROM e) * 100, 1) AS share FROM e GROUP BY ext""",
)
def file_types(t):
    return W.file_types(t.pages.selectExpr("url AS source_path"))


@query(
    "dashboard_totals",
    with_(DEADLINES, RULE_COURSES, BY_COURSE, CHUNK_LINES, COLLECTIONS, COMPOSITION)
    + """SELECT * FROM (SELECT sum(remaining)::BIGINT AS deadlines_remaining, sum(exam)::BIGINT AS exams_remaining,
    sum(quiz)::BIGINT AS quizzes_remaining, sum(project)::BIGINT AS projects_remaining FROM by_course),
  (SELECT sum(docs)::BIGINT AS docs, sum(chunks)::BIGINT AS chunks, count(*) FILTER (chunks > 0) AS collections_indexed,
    count(*) AS collections_total FROM composition)""",
)
def dashboard_totals(t):
    return W.dashboard_totals(
        W.by_course(deadlines(t.events), rule_courses(t), NOW), W.index_composition(chunk_lines(t), collections(t))
    )


@query(
    "table_census",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in TABLES),
)
def table_census(t):
    return W.table_census({name: getattr(t, name) for name in TABLES})


TERM = """terms AS (SELECT o_orderkey, o_orderdate::DATE AS today, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)"""
TERM_COLS = """o_orderkey, today, y || ' ' || CASE WHEN m >= 8 THEN 'Fall' WHEN m <= 5 THEN 'Spring' ELSE 'Summer' END AS term,
  CASE WHEN m >= 8 THEN make_date(y, 8, 1) WHEN m <= 5 THEN make_date(y, 1, 1) ELSE make_date(y, 5, 1) END AS start,
  CASE WHEN m >= 8 THEN make_date(y, 12, 31) WHEN m <= 5 THEN make_date(y, 5, 31) ELSE make_date(y, 8, 31) END AS "end" """


def _terms(t):
    from ledgerloom.functions.dates import term_end, term_name, term_start

    return t.orders.selectExpr("o_orderkey", "cast(o_orderdate AS date) AS today").selectExpr(
        "o_orderkey", "today", f"{term_name('today')} AS term", f"{term_start('today')} AS start", f"{term_end('today')} AS end"
    )


@query("term_of", with_(TERM) + f"SELECT {TERM_COLS} FROM terms")
def term_of(t):
    return _terms(t)


@query(
    "semester_progress",
    with_(TERM, f"b AS (SELECT {TERM_COLS} FROM terms)")
    + """SELECT o_orderkey, today, datediff('day', start, "end") AS total_days, greatest(0, datediff('day', start, today)) AS elapsed_days,
greatest(0, datediff('day', today, "end")) AS days_remaining, greatest(0, floor(datediff('day', today, "end") / 7))::INT AS weeks_remaining,
round_even(100 * greatest(0, least(1, datediff('day', start, today) / datediff('day', start, "end"))), 1) AS pct_elapsed FROM b""",
)
def semester_progress(t):
    return W.semester_progress(_terms(t)).drop("term", "start", "end")


@query(
    "accept_window",
    """SELECT o_orderkey, o_orderdate::DATE AS date FROM orders
WHERE o_orderdate::DATE BETWEEN DATE '1998-03-01' - 30 AND least(DATE '1998-03-01' + 240, DATE '1998-05-22')""",
)
def accept_window(t):
    items = t.orders.select("o_orderkey", F.expr("cast(o_orderdate AS date) AS date"))
    return W.accept_window(items, "1998-03-01", cap="1998-05-22")


@query(
    "empty_collections",
    """SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9990)""",
)
def empty_collections(t):
    """Configured collections (nations) that hold no row (rich customer)."""
    filled = t.customer.where("c_acctbal > 9990").select(F.col("c_nationkey").alias("n_nationkey"))
    return t.nation.join(filled, "n_nationkey", "left_anti").select("n_nationkey", "n_name")
