"""Query keys of reconciliation, change application and completions."""

from pyspark.sql import functions as F

from ledgerloom.functions import titles as H
from ledgerloom.operators import reconcile as R
from ledgerloom.plans.registry import query
from ledgerloom.plans.text_plans import KEY, TITLE_PARTS
from ledgerloom.plans.views import DEADLINES, TITLES, with_
from ledgerloom.sources.tables import TODAY, WORK_NAMES, deadlines, pulled_work, sql_list, stored_work, titles

WORK = f"""work AS (SELECT o_orderkey AS k, 'FINC' || (300 + (o_orderkey // 10) % 40) AS course,
    CASE WHEN o_orderkey % 17 = 0 THEN 'VHL Supersite homework ' || o_orderkey WHEN o_orderkey % 10 >= 7
      THEN ([{sql_list(WORK_NAMES)}])[(o_orderkey // 10) % {len(WORK_NAMES)} + 1] || ' series ' || (o_orderkey // 10)
      ELSE ([{sql_list(WORK_NAMES)}])[(o_orderkey // 10) % {len(WORK_NAMES)} + 1] || ' ' || o_orderkey END AS title,
    o_orderdate::DATE AS date, 8 + o_orderkey % 10 AS hour FROM orders),
stored0 AS (SELECT k AS id, course, title, date, lpad(hour::VARCHAR, 2, '0') || ':00' AS start_time, CASE WHEN k % 3 = 0 THEN (hour + 2) || ':30' ELSE '' END AS end_time,
    CASE WHEN k % 5 = 0 THEN 'ics' ELSE 'csv' END AS source FROM work),
pulled0 AS (SELECT k * 2 + c AS pos, course, CASE WHEN k % 17 = 0 THEN 'Supersite: ' || (1 + k % 9) || ' activities' WHEN k % 11 = 0 THEN 'Brand new task ' || (k + 1000000)
      WHEN k % 13 = 0 THEN 'Updated online version: ' || title ELSE title || ' [synced]' END AS title,
    CASE WHEN k % 19 = 0 THEN NULL WHEN k % 7 = 0 THEN (date + 3)::DATE ELSE date END AS date,
    lpad((CASE WHEN k % 4 = 0 THEN hour + 1 ELSE hour END)::VARCHAR, 2, '0') || ':00' AS start_time, CASE WHEN k % 29 = 0 THEN '21:45' ELSE '' END AS end_time,
    CASE WHEN k % 17 = 0 THEN 'vhl' ELSE 'lms' END AS site,
    CASE WHEN k % 8 = 0 THEN [lpad(hour::VARCHAR, 2, '0') || ':00', '23:59'] ELSE []::VARCHAR[] END AS known_times
  FROM work, range(2) r(c) WHERE c = 0 OR k % 23 = 0)"""


def parts(name: str, src: str) -> str:
    """A table with key, words and nums added."""
    inner = TITLE_PARTS.format(src=src).replace("title_parts AS", f"{name}_p AS", 1)
    return inner + f",\n{name} AS (SELECT *, {KEY} AS key, lower(regexp_extract(course, '^([A-Za-z]+)', 1)) AS dept, regexp_extract(course, '0*([0-9]+)$', 1) AS cnum FROM {name}_p)"


RECON = f"""slots AS (SELECT DISTINCT key, date FROM stored),
keys AS (SELECT key, count(DISTINCT date) AS n, min(date) AS only_date FROM stored GROUP BY key),
csv_times AS (SELECT DISTINCT key, date, start_time AS t FROM stored WHERE source = 'csv' AND start_time <> ''),
dated AS (SELECT * FROM pulled WHERE date IS NOT NULL),
src_times AS (SELECT DISTINCT key, date, unnest(list_append(known_times, start_time)) AS t FROM dated),
slot_times AS (SELECT key, date, list(t ORDER BY t) AS ts, bool_or(EXISTS (SELECT 1 FROM src_times s WHERE s.key = c.key AND s.date = c.date AND s.t = c.t)) AS vouched FROM csv_times c GROUP BY key, date),
plat AS (SELECT DISTINCT upper(course) AS up, date FROM stored WHERE list_has_any(words, ['vhl', 'supersite'])),
x_hits AS (SELECT p.pos, s.start_time AS t, s.source FROM (SELECT * FROM dated WHERE key NOT IN (SELECT key FROM keys) AND nums <> '' AND nums <> cnum) p
  JOIN stored s ON upper(s.course) = upper(p.course) AND s.nums = p.nums AND s.date = p.date
  WHERE len(list_filter(list_intersect(s.words, p.words), lambda w: w <> p.dept)) > 0),
cross_ AS (SELECT h.pos, coalesce(list(DISTINCT t ORDER BY t) FILTER (source = 'csv' AND t <> ''), []) AS ts,
    coalesce(bool_or(source = 'csv' AND EXISTS (SELECT 1 FROM src_times s, dated d WHERE d.pos = h.pos AND s.key = d.key AND s.date = d.date AND s.t = h.t)), false) AS vouched FROM x_hits h GROUP BY h.pos),
judged AS (SELECT d.*, k.only_date, CASE WHEN d.site = 'vhl' AND EXISTS (SELECT 1 FROM plat b WHERE b.up = upper(d.course) AND b.date = d.date) THEN 'present'
    WHEN k.key IS NULL AND c.pos IS NULL THEN 'new'
    WHEN k.key IS NULL THEN CASE WHEN len(c.ts) > 0 AND NOT c.vouched AND d.date >= DATE '{TODAY}' THEN 'retimed' ELSE 'present' END
    WHEN sl.key IS NOT NULL THEN CASE WHEN k.n = 1 AND st.ts IS NOT NULL AND NOT st.vouched AND d.date >= DATE '{TODAY}' THEN 'retimed' ELSE 'present' END
    WHEN k.n = 1 AND NOT EXISTS (SELECT 1 FROM dated o WHERE o.key = d.key AND o.date = k.only_date) THEN 'moved' ELSE 'new' END AS verdict,
    coalesce(c.ts, st.ts) AS ts FROM dated d LEFT JOIN keys k ON k.key = d.key LEFT JOIN slots sl ON sl.key = d.key AND sl.date = d.date
  LEFT JOIN slot_times st ON st.key = d.key AND st.date = d.date LEFT JOIN cross_ c ON c.pos = d.pos),
step1 AS (SELECT *, CASE WHEN verdict = 'moved' AND row_number() OVER (PARTITION BY key, verdict ORDER BY pos) > 1 THEN 'new'
    WHEN verdict = 'retimed' AND row_number() OVER (PARTITION BY key, date, verdict ORDER BY pos) > 1 THEN 'present' ELSE verdict END AS v FROM judged),
step2 AS (SELECT *, CASE WHEN v = 'new' AND row_number() OVER (PARTITION BY key, date, v ORDER BY pos) > 1 THEN 'dropped' ELSE v END AS v2 FROM step1),
changes AS (SELECT CASE v2 WHEN 'new' THEN 'new' ELSE 'moved' END AS kind, key, course, title, s.date, start_time, end_time, site, pos,
    CASE v2 WHEN 'moved' THEN only_date WHEN 'retimed' THEN s.date END AS old_date,
    CASE v2 WHEN 'moved' THEN coalesce((SELECT ts FROM slot_times t WHERE t.key = s.key AND t.date = s.only_date), []) WHEN 'retimed' THEN ts ELSE [] END AS old_times
  FROM step2 s WHERE v2 IN ('new', 'moved', 'retimed'))"""
REC = with_(WORK, parts("stored", "stored0"), parts("pulled", "pulled0"), RECON)
CHANGE_COLS = "kind, key, title, date, start_time, pos, old_date, array_to_string(old_times, ',') AS old_times"


def verdicts(t):
    return R.reconcile(pulled_work(t.orders), stored_work(t.orders), TODAY)


def changes(t):
    return verdicts(t).where("kind <> 'present'")


def change_row(df):
    return df.select("kind", "key", "title", "date", "start_time", "pos", "old_date", F.array_join("old_times", ",").alias("old_times"))


@query("reconcile", REC + f"SELECT {CHANGE_COLS} FROM changes")
def reconcile(t):
    return change_row(changes(t))


@query(
    "reconcile_counts",
    REC + """SELECT course, count(*) FILTER (v2 = 'new') AS new, count(*) FILTER (v2 IN ('moved', 'retimed')) AS moved, count(*) FILTER (v2 = 'present') AS present FROM step2 WHERE v2 <> 'dropped' GROUP BY course""",
)
def reconcile_counts(t):
    return verdicts(t).groupBy("course").agg(
        *[F.expr(f"coalesce(sum(n) FILTER (WHERE kind = '{k}'), 0) AS {k}") for k in ("new", "moved", "present")]
    )


@query("retimed", REC + f"SELECT {CHANGE_COLS} FROM changes WHERE date = old_date")
def retimed(t):
    return change_row(changes(t).where("date = old_date"))


@query(
    "ignore_list",
    REC + f"SELECT {CHANGE_COLS} FROM changes WHERE key NOT IN (SELECT s.key FROM stored s JOIN orders o ON o.o_orderkey = s.id WHERE o.o_orderstatus = 'P')",
)
def ignore_list(t):
    muted = stored_work(t.orders.where("o_orderstatus = 'P'")).select(F.expr(f"{H.title_key('course', 'title')} AS key"))
    return change_row(R.ignore_listed(changes(t), muted))


@query(
    "platform_bucket",
    REC + "SELECT pos, course, title FROM dated d WHERE site = 'vhl' AND EXISTS (SELECT 1 FROM plat b WHERE b.up = upper(d.course) AND b.date = d.date)",
)
def platform_bucket(t):
    return R.platform_bucket(pulled_work(t.orders), stored_work(t.orders)).select("pos", "course", "title")


@query(
    "cross_worded",
    with_(TITLES, "reworded AS (SELECT id, course, 'Connect online ' || title AS title FROM titles)", parts("a", "titles"), parts("b", "reworded"))
    + """SELECT a.id, min(b.id) AS match FROM a JOIN b ON a.course = b.course AND a.nums = b.nums AND a.nums <> '' AND a.nums <> a.cnum
WHERE len(list_filter(list_intersect(a.words, b.words), lambda w: w <> a.dept)) > 0 GROUP BY a.id""",
)
def cross_worded(t):
    left = titles(t.part)
    return R.cross_worded(left, left.withColumn("title", F.expr("concat('Connect online ', title)")))


APPLY = f"""mv AS (SELECT *, CASE WHEN len(old_times) = 0 THEN [NULL]::VARCHAR[] ELSE old_times END AS want FROM changes WHERE kind = 'moved'),
mvp AS (SELECT m.*, p.nums, p.words, p.dept, p.cnum FROM mv m JOIN pulled p ON p.pos = m.pos),
slot_rows AS (SELECT m.pos, s.id, s.key = m.key AS exact, m.nums <> '' AND m.nums = s.nums AND m.nums <> m.cnum AND len(list_filter(list_intersect(s.words, m.words), lambda w: w <> m.dept)) > 0 AS loose
  FROM mvp m JOIN stored s ON s.course = m.course AND s.date = m.old_date AND (len(m.old_times) = 0 OR list_contains(m.old_times, s.start_time))),
tier AS (SELECT pos, id FROM slot_rows r WHERE exact OR (loose AND NOT EXISTS (SELECT 1 FROM slot_rows e WHERE e.pos = r.pos AND e.exact))),
cand AS (SELECT pos, count(*) AS hits, min(id) AS id FROM tier GROUP BY pos),
won AS (SELECT id, min(pos) AS pos FROM cand WHERE hits = 1 GROUP BY id),
already AS (SELECT DISTINCT m.pos FROM mvp m JOIN stored s ON s.course = m.course AND s.date = m.date WHERE s.key = m.key
  OR (m.nums <> '' AND m.nums = s.nums AND m.nums <> m.cnum AND len(list_filter(list_intersect(s.words, m.words), lambda w: w <> m.dept)) > 0)),
rewritten AS (SELECT s.id, s.course, s.title, coalesce(m.date, s.date) AS date, coalesce(m.start_time, s.start_time) AS start_time,
    CASE WHEN m.pos IS NULL THEN s.end_time WHEN m.end_time <> '' THEN m.end_time WHEN s.end_time <> '' AND lpad(s.end_time, 5, '0') > m.start_time THEN lpad(s.end_time, 5, '0') ELSE '' END AS end_time,
    m.pos IS NOT NULL AS rewritten FROM stored s LEFT JOIN won w ON w.id = s.id LEFT JOIN mv m ON m.pos = w.pos),
actions AS (SELECT m.pos, CASE WHEN c.hits > 1 THEN 'ambiguous' WHEN w.pos IS NOT NULL THEN 'rewritten' WHEN m.date = m.old_date OR a.pos IS NOT NULL THEN 'left' ELSE 'append' END AS action
  FROM mv m LEFT JOIN cand c ON c.pos = m.pos LEFT JOIN won w ON w.pos = m.pos LEFT JOIN already a ON a.pos = m.pos)"""
APP = with_(WORK, parts("stored", "stored0"), parts("pulled", "pulled0"), RECON, APPLY)


@query("apply_moves", APP + "SELECT * FROM rewritten")
def apply_moves(t):
    rows, _ = R.apply_moves(stored_work(t.orders), changes(t).where("kind = 'moved'"))
    return rows.drop("all_day", "source")


@query("move_actions", APP + "SELECT * FROM actions")
def move_actions(t):
    return R.apply_moves(stored_work(t.orders), changes(t).where("kind = 'moved'"))[1]


@query(
    "append_dedup",
    with_(WORK) + """SELECT course, title, date, start_time, end_time, pos FROM (SELECT *, row_number() OVER (PARTITION BY course, title, date ORDER BY pos) AS rn
FROM pulled0 p WHERE date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stored0 s WHERE s.course = p.course AND s.title = p.title AND s.date = p.date)) WHERE rn = 1""",
)
def append_dedup(t):
    return R.append_new(stored_work(t.orders), pulled_work(t.orders)).drop("all_day")


# ------------------------------------------------------------------ authority merge

QUIZ_VIEWS = """items AS (SELECT id AS pos, course, title, starts_at::DATE AS date, CASE WHEN all_day THEN '' ELSE strftime(starts_at, '%H:%M') END AS start_time, kind, source FROM deadlines),
quiz0 AS (SELECT *, CASE WHEN start_time = '' THEN []::VARCHAR[] ELSE [start_time] END AS known_times, [(date - 1)::DATE, date, (date + 1)::DATE] AS known_dates FROM items WHERE kind = 'quiz' AND source = 'csv'),
event0 AS (SELECT * FROM items WHERE kind IN ('quiz', 'project') AND source <> 'csv')"""


def calendar_items(t):
    return deadlines(t.events).selectExpr(
        "id AS pos", "course", "title", "cast(starts_at AS date) AS date", "if(all_day, '', date_format(starts_at, 'HH:mm')) AS start_time", "kind", "source"
    )


@query(
    "authority_merge",
    with_(DEADLINES, QUIZ_VIEWS, parts("quiz", "quiz0"), parts("ev", "event0"))
    + """, owned AS (SELECT e.*, (SELECT min(q.pos) FROM quiz q WHERE q.key = e.key AND list_contains(q.known_dates, e.date)) AS owner FROM ev e),
added AS (SELECT owner, list(DISTINCT start_time) AS ts FROM owned WHERE owner IS NOT NULL AND start_time <> '' GROUP BY owner),
rest AS (SELECT *, row_number() OVER (PARTITION BY course, key, date ORDER BY start_time DESC, pos) AS rn, count(*) OVER (PARTITION BY course, key, date) AS n,
  list(start_time) FILTER (start_time <> '') OVER (PARTITION BY course, key, date) AS ts FROM owned WHERE owner IS NULL)
SELECT 'quiz' AS record, q.pos, course, key, date, start_time, array_to_string(list_sort(list_distinct(list_concat(known_times, coalesce(a.ts, [])))), ',') AS known_times
FROM quiz q LEFT JOIN added a ON a.owner = q.pos
UNION ALL SELECT 'event', pos, course, key, date, start_time, CASE WHEN n = 1 THEN '' ELSE array_to_string(list_sort(list_distinct(coalesce(ts, []))), ',') END FROM rest WHERE rn = 1""",
)
def authority_merge(t):
    items = calendar_items(t)
    quizzes = items.where("kind = 'quiz' AND source = 'csv'").withColumns(
        {
            "known_times": F.expr("filter(array(start_time), x -> x <> '')"),
            "known_dates": F.expr("array(date_sub(date, 1), date, date_add(date, 1))"),
        }
    )
    events = items.where("kind IN ('quiz', 'project') AND source <> 'csv'")
    return R.authority_merge(events, quizzes).withColumn("known_times", F.array_join("known_times", ","))


# ------------------------------------------------------------------ completions

COMPLETION = """log0 AS (SELECT event_id AS line_no, 'C' || (user_id % 12) AS course, ts::DATE AS date, CAST(props->>'$.k' AS INT) % 5 <> 0 AS done,
    CASE event_id % 3 WHEN 0 THEN CASE event_type WHEN 'purchase' THEN 'Exam ' WHEN 'click' THEN 'Quiz ' ELSE 'Task ' END || (CAST(props->>'$.k' AS INT) % 20)
      WHEN 1 THEN 'Chapter Quiz ' || (CAST(props->>'$.k' AS INT) % 20) || ' online' ELSE 'VHL homework' END AS title FROM events),
due0 AS (SELECT id, course, starts_at::DATE AS date, CASE WHEN kind = 'admin' THEN 'Supersite: ' || title ELSE title END AS title FROM deadlines)"""
STATE = """state AS (SELECT upper(course) AS up, key, date, title, done, words, nums, cnum, dept FROM (SELECT *, row_number() OVER (PARTITION BY upper(course), key, date ORDER BY line_no DESC) AS rn FROM log) WHERE rn = 1)"""


def completion_log(t):
    k = "cast(get_json_object(props, '$.k') AS int)"
    return t.events.selectExpr(
        "event_id AS line_no", "concat('C', user_id % 12) AS course", "cast(ts AS date) AS date", f"{k} % 5 <> 0 AS done",
        f"CASE event_id % 3 WHEN 0 THEN concat(CASE event_type WHEN 'purchase' THEN 'Exam ' WHEN 'click' THEN 'Quiz ' ELSE 'Task ' END, {k} % 20)"
        f" WHEN 1 THEN concat('Chapter Quiz ', {k} % 20, ' online') ELSE 'VHL homework' END AS title",
    ).withColumn("key", F.expr(H.title_key("course", "title")))


CMP = with_(DEADLINES, COMPLETION, parts("log", "log0"), STATE, parts("due", "due0"))


@query("completion_state", CMP + "SELECT up, key, date, title, done FROM state")
def completion_state(t):
    return R.completion_state(completion_log(t))


@query("completion_stats", CMP + "SELECT count(*) AS total, count(*) FILTER (done) AS done FROM state")
def completion_stats(t):
    return R.completion_stats(R.completion_state(completion_log(t)))


@query(
    "is_done",
    CMP + """SELECT d.id, CASE WHEN s.done IS NOT NULL THEN s.done ELSE EXISTS (SELECT 1 FROM state c WHERE c.done AND c.up = upper(d.course) AND c.date = d.date AND (
  (d.nums <> '' AND d.nums = c.nums AND d.nums <> d.cnum AND len(list_filter(list_intersect(c.words, d.words), lambda w: w <> d.dept)) > 0)
  OR (list_has_any(d.words, ['vhl', 'supersite']) AND len(list_filter(list_intersect(c.words, d.words), lambda w: w IN ('vhl', 'supersite'))) > 0))) END AS done
FROM due d LEFT JOIN state s ON s.up = upper(d.course) AND s.key = d.key AND s.date = d.date""",
)
def is_done(t):
    due = deadlines(t.events).selectExpr("id", "course", "if(kind = 'admin', concat('Supersite: ', title), title) AS title", "cast(starts_at AS date) AS date")
    return R.is_done(due, R.completion_state(completion_log(t)))
