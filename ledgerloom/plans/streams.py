"""Query keys of the streaming jobs, each run over all available input."""

import re

from pyspark.sql import functions as F

from ledgerloom.operators import chunking, reconcile
from ledgerloom.plans.corpus import LIBRARY_CHUNKS
from ledgerloom.plans.reconcile import APPLY, CMP, RECON, WORK, completion_log, parts
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import with_
from ledgerloom.session import materialize, shared_dir
from ledgerloom.sources.tables import TODAY, corpus_files, pulled_work, stored_work
from ledgerloom.sources.versions import VersionedTable
from ledgerloom.streaming import jobs as J
from ledgerloom.streaming import state as K


def event_stream(t):
    return J.with_clock(J.file_stream(t.spark, t.sf_dir, "events.parquet", t.events.schema))


#: Three polls, ten days each. The second meets a site that is down.
POLL = "least(2, datediff(ts, date'2024-01-01') div 10)"
POLLED = """polled AS (SELECT *, least(2, (ts::DATE - DATE '2024-01-01') // 10)::BIGINT AS run_id FROM events)"""


def _polls(t):
    """(folder of the items by site, folder of the statuses) after three polls."""
    spark, out, status = t.spark, shared_dir(t.spark, "poll"), shared_dir(t.spark, "poll-status")
    folder = J.staged_files([t.events.where(f"{POLL} = {k}") for k in range(3)], shared_dir(spark, "poll-in"))

    def apply(batch, batch_id):
        up = batch.where(F.expr(f"assert_true({POLL} <> 1, 'site is down') IS NULL"))
        sites = up.groupBy(F.col("event_type").alias("site")).agg(F.count("*").alias("items"), F.expr("count_if(value > 50) AS new"))
        sites.withColumn("run_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/run={batch_id}")

    body = J.poll_into(status, {"items": "count(*)", "new": "count_if(value > 50)"}, apply)
    J.run_batches(J.file_stream(spark, folder, "*.parquet", t.events.schema, 1), body, "poll")
    return out, status


@query(
    "stream_poll",
    f"""WITH {POLLED} SELECT event_type AS site, count(*) AS items, count(*) FILTER (value > 50) AS new, run_id FROM polled WHERE run_id <> 1 GROUP BY event_type, run_id""",
)
def stream_poll(t):
    """What three polls found; a failed one leaves nothing and ends nothing."""
    out, _ = _polls(t)
    return t.spark.read.schema("site string, items long, new long, run_id long").parquet(f"{out}/run=0", f"{out}/run=2")


@query(
    "poll_statuses",
    f"""WITH {POLLED}, s AS (SELECT run_id, count(*) AS items, count(*) FILTER (value > 50) AS new FROM polled GROUP BY run_id)
SELECT run_id, true AS ok, items, new, false AS failed FROM s WHERE run_id <> 1 UNION ALL SELECT 1, false, items, new, true FROM s WHERE run_id = 0""",
)
def poll_statuses(t):
    """The status of each poll, its counters observed while the poll ran; a failed one repeats the last counters."""
    _, status = _polls(t)
    rows = t.spark.read.schema("run_id long, ok boolean, items long, new long, error string").option("recursiveFileLookup", "true").parquet(status)
    return rows.selectExpr("run_id", "ok", "items", "new", "error LIKE '%site is down%' AS failed").na.fill(False, ["failed"])


#: Events stretched over more than a year, so that keys fall silent and are due again.
START = "timestamp_ntz'2024-01-01 00:00:00'"
LONG = """long0 AS (SELECT event_id, user_id, event_type, props, (TIMESTAMP '2024-01-01' + 14 * (ts - TIMESTAMP '2024-01-01'))::DATE AS day FROM events),
long AS (SELECT *, least(3, greatest(0, (day - DATE '2024-01-01') // 105)) AS quarter FROM long0)"""


def long_events(t):
    """event_id, user_id, event_type, props, day, quarter of the stretched events."""
    day = f"cast(timestampadd(MICROSECOND, 14 * timestampdiff(MICROSECOND, {START}, ts), {START}) AS date)"
    return t.events.selectExpr("event_id", "user_id", "event_type", "props", f"{day} AS day").withColumn(
        "quarter", F.expr("least(3, greatest(0, datediff(day, date'2024-01-01') div 105))")
    )


def in_runs(rows, batch, last, build, purpose, runs=2):
    """The output of a stream over files 0 to ``last``, one per batch; with two runs it is stopped half way and started again."""
    spark = rows.sparkSession
    folder, out, checkpoint = (shared_dir(spark, f"{purpose}-{n}") for n in ("in", "out", "checkpoint"))
    parts = [rows.where(F.expr(batch) == k) for k in range(last + 1)]
    found = None
    step = -(-len(parts) // runs)
    for some in (parts[at : at + step] for at in range(0, len(parts), step)):
        J.staged_files(some, folder)
        found = K.run_stateful(build(J.file_stream(spark, folder, "*.parquet", rows.schema, 1)), purpose, out, checkpoint)
    return found


@query(
    "stream_dedup",
    """WITH RECURSIVE d AS (SELECT DISTINCT user_id, event_type, (TIMESTAMP '2024-01-01' + 14 * (ts - TIMESTAMP '2024-01-01'))::DATE AS day FROM events),
p AS (SELECT user_id, event_type, min(day) AS day FROM d GROUP BY 1, 2
  UNION ALL SELECT p.user_id, p.event_type, (SELECT min(d.day) FROM d WHERE d.user_id = p.user_id AND d.event_type = p.event_type AND d.day - p.day > 120) AS nxt FROM p WHERE p.day IS NOT NULL)
SELECT user_id, event_type, day FROM p WHERE day IS NOT NULL""",
)
def stream_dedup(t):
    """Four batches: keys fall silent for 120 days and are due again."""
    due = lambda rows: K.due_notifications(rows, ["user_id", "event_type"], buckets=K.BUCKETS)
    return in_runs(long_events(t), "quarter", 3, due, "dedup", runs=1)


#: A seventh of the rows arrives a file late, every 49th two files late.
LATE = "quarter + CASE WHEN event_id % 49 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END"
ARRIVED = f"""arrived AS (SELECT *, {LATE} AS batch FROM long),
marks AS (SELECT b.batch, max(a.day) - 60 AS mark FROM (SELECT DISTINCT batch FROM arrived) b LEFT JOIN arrived a ON a.batch < b.batch GROUP BY b.batch),
accepted AS (SELECT a.* FROM arrived a JOIN marks m USING (batch) WHERE mark IS NULL OR a.day > mark)"""


@query(
    "stream_notify_late",
    f"""WITH RECURSIVE {LONG}, {ARRIVED},
d AS (SELECT user_id, event_type, day, row_number() OVER (PARTITION BY user_id, event_type ORDER BY batch, day) AS n FROM (SELECT DISTINCT user_id, event_type, batch, day FROM accepted)),
p AS (SELECT user_id, event_type, day, n FROM d WHERE n = 1
  UNION ALL SELECT * FROM (SELECT p.user_id, p.event_type, d.day, d.n FROM p JOIN d ON d.user_id = p.user_id AND d.event_type = p.event_type AND d.n > p.n AND d.day - p.day > 120
    QUALIFY row_number() OVER (PARTITION BY p.user_id, p.event_type ORDER BY d.n) = 1))
SELECT user_id, event_type, day FROM p""",
)
def stream_notify_late(t):
    """Six batches with rows that come one or two files late: those behind the watermark by then change nothing."""
    due = lambda rows: K.due_notifications(rows, ["user_id", "event_type"], delay_days=60)
    return in_runs(long_events(t), LATE, 5, due, "notify-late")


@query("stream_completions", CMP + "SELECT up, key, date, title, done FROM state")
def stream_completions(t):
    """The log in four files: the last change per slot of the keyed state equals the batch fold."""
    slot = ["up", "key", "date"]
    log = completion_log(t).selectExpr("upper(course) AS up", "key", "date", "line_no", "title", "done")
    changes = lambda rows: K.slot_changes(rows, slot, ["title", "done"], day="date")
    found = in_runs(log, "least(3, greatest(0, datediff(date, date'2024-01-01') div 8))", 3, changes, "completions")
    return found.groupBy(*slot).agg(F.expr("max(struct(line_no, title, done)) AS s")).select(*slot, "s.title", "s.done")


@query(
    "stream_slot_changes",
    f"""WITH {LONG}, {ARRIVED},
lines AS (SELECT user_id % 12 AS course, event_type AS kind, batch, event_id AS line_no, CAST(props->>'$.k' AS INT) % 3 <> 0 AS done, day FROM accepted),
seen AS (SELECT *, max(line_no) OVER (PARTITION BY course, kind ORDER BY batch, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM lines),
known AS (SELECT *, lag(done) OVER w AS old, lag(day) OVER w AS since FROM seen WHERE newest IS NULL OR line_no > newest WINDOW w AS (PARTITION BY course, kind ORDER BY line_no))
SELECT course, kind, line_no, done, day FROM known WHERE since IS NULL OR day - since > 2 OR done <> old""",
)
def stream_slot_changes(t):
    """Lines that change what is known of a slot, over six batches with late lines; slots are forgotten after two days."""
    rows = long_events(t)
    lines = lambda s: s.selectExpr("user_id % 12 AS course", "event_type AS kind", "event_id AS line_no", "cast(get_json_object(props, '$.k') AS int) % 3 <> 0 AS done", "day")
    changes = lambda s: K.slot_changes(lines(s), ["course", "kind"], ["done"], keep_days=2, delay_days=60)
    return in_runs(rows, LATE, 5, changes, "slot-changes").select("course", "kind", "line_no", "done", "day")


LAST = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query(
    "stream_week_load",
    f"""SELECT date_trunc('week', ts)::DATE AS week_start, count(*) AS count FROM events GROUP BY 1 HAVING date_trunc('week', min(ts)) + INTERVAL 7 DAY <= {LAST}""",
)
def stream_week_load(t):
    """Weeks that have closed by the end of the input."""
    return J.run_available(J.week_load(event_stream(t)), "weeks")


@query("stream_day_load", f"SELECT ts::DATE AS date, count(*) AS count FROM events GROUP BY 1 HAVING (ts::DATE + 1)::TIMESTAMP <= {LAST}")
def stream_day_load(t):
    return J.run_available(J.day_load(event_stream(t)), "days")


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM i GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {LAST}""",
)
def stream_sessions(t):
    return J.run_available(J.sessions(event_stream(t), ["user_id"], "6 hours"), "sessions")


def _indexed(t):
    """Documents arrive in three batches, some a second time and some in a newer version."""
    spark = t.spark
    docs = corpus_files(t.documents)
    old = docs.where("doc_id % 9 = 0").selectExpr("* EXCEPT (text, size, mtime)", "mtime - INTERVAL '1' DAY AS mtime", "size + 7 AS size", "concat(text, ' Old.\\n# Gone') AS text").select(*docs.columns)
    parts = [docs.where("doc_id % 3 = 0 AND doc_id % 9 <> 0").unionByName(old), docs.where("doc_id % 3 = 1 OR doc_id % 6 = 0 AND doc_id % 9 <> 0"), docs.where("doc_id % 3 = 2 OR doc_id % 9 = 0")]
    out = shared_dir(spark, "index")
    J.run_parts(parts, J.index_into(out, chunking.chunk_files, docs.schema), "arrivals")
    return out, docs.schema


@query("stream_index", LIBRARY_CHUNKS)
def stream_index(t):
    """The index after three batches holds the last version of every document once."""
    out, schema = _indexed(t)
    return J.current_index(t.spark, out, schema).select("collection", "source_path", "locator", "content_hash")


@query(
    "stream_index_report",
    """WITH n AS (SELECT doc_id % 3 AS r3, doc_id % 6 AS r6, doc_id % 9 AS r9 FROM documents)
SELECT 0::BIGINT AS batch, count(*) FILTER (r3 = 0) AS scanned, count(*) FILTER (r3 = 0) AS indexed, 0::BIGINT AS skipped FROM n
UNION ALL SELECT 1, count(*) FILTER (r3 = 1 OR r6 = 0 AND r9 <> 0), count(*) FILTER (r3 = 1), count(*) FILTER (r6 = 0 AND r9 <> 0) FROM n
UNION ALL SELECT 2, count(*) FILTER (r3 = 2 OR r9 = 0), count(*) FILTER (r3 = 2 OR r9 = 0), 0 FROM n""",
)
def stream_index_report(t):
    """What each batch scanned, indexed and skipped, observed while it ran."""
    out, _ = _indexed(t)
    return t.spark.read.schema(J.INDEX_REPORT).option("recursiveFileLookup", "true").parquet(f"{out}/report").drop("chunks_added")


@query(
    "stream_seen",
    "SELECT user_id, event_type, min(least(4, (ts::DATE - DATE '2024-01-01') // 6))::BIGINT AS batch FROM events GROUP BY user_id, event_type",
)
def stream_seen(t):
    """Five batches in two runs; keys come again in later batches and are new only once."""
    spark, keys = t.spark, ["user_id", "event_type"]
    rows = t.events.select("event_id", *keys, F.expr("least(4, datediff(ts, date'2024-01-01') div 6) AS part"))
    folder, out, checkpoint = (shared_dir(spark, f"announcements-{n}") for n in ("in", "out", "checkpoint"))
    seen = J.seen_table(spark, shared_dir(spark, "seen"), rows.schema, keys)
    for parts in ((0, 1), (2, 3, 4)):
        J.staged_files([rows.where(f"part = {k}") for k in parts], folder)
        J.run_batches(J.file_stream(spark, folder, "*.parquet", rows.schema, 1), J.unseen_into(out, seen, keys), "announcements", checkpoint=checkpoint)
    return J.unseen_items(spark, out, rows.schema).select(*keys, "batch")


@query("late_split", "SELECT event_id, ts::DATE AS date, ts::DATE < DATE '2024-01-25' - 14 AS late FROM events")
def late_split(t):
    rows = event_stream(t).select("event_id", F.expr(f"cast({J.wall_time('ts')} AS date) AS date"))
    return J.run_available(J.late_split(rows, "2024-01-25", back=14), "late")


#: The pulled items in four files: every order in one, some again later with another date, so that they move twice.
FILE = "k % 4"
AGAIN = "k % 5 = 1 AND k % 4 < 3"


def _batch_sql(k: int) -> str:
    """The common table expressions of batch k: what is pulled, judged and applied against the table of batch k - 1."""
    state = f"""held{k} AS (SELECT * FROM state{k})"""
    pull = f"""pull{k} AS (SELECT p.* FROM pulled0 p WHERE (pos // 2) % 4 = {k}
  UNION ALL SELECT pos + 1000000000, course, title, (date + {k})::DATE, start_time, end_time, site, known_times FROM pulled0 WHERE (pos // 2) % 5 = 1 AND (pos // 2) % 4 = {k} - 1)"""
    own = "SELECT * FROM stored WHERE source = 'csv'"
    apply = APPLY.replace("FROM stored s", f"FROM ({own}) s").replace("JOIN stored s", f"JOIN ({own}) s")
    after = """fresh AS (SELECT * FROM changes WHERE kind = 'new' OR pos IN (SELECT pos FROM actions WHERE action = 'append')),
added AS (SELECT -1 - pos AS id, course, title, date, start_time, end_time, 'csv' AS source FROM (SELECT *, row_number() OVER (PARTITION BY course, title, date ORDER BY pos) AS rn FROM fresh f
  WHERE NOT EXISTS (SELECT 1 FROM rewritten r WHERE r.course = f.course AND r.title = f.title AND r.date = f.date)) WHERE rn = 1)"""
    text = ",\n".join([parts("stored", f"held{k}"), parts("pulled", f"pull{k}"), RECON, apply, after])
    for name in re.findall(r"(?:^|,\n)(\w+) AS \(", text):
        text = _renamed(text, name, f"{name}_{k}")
    after = f"""state{k + 1} AS (SELECT id, course, title, date, start_time, end_time, 'csv' AS source FROM rewritten_{k}
  UNION ALL SELECT id, course, title, date, start_time, end_time, source FROM added_{k}
  UNION ALL SELECT id, course, title, date, start_time, end_time, source FROM held{k} WHERE source <> 'csv')"""
    return ",\n".join([state, pull, text, after])


def _renamed(text: str, name: str, new: str) -> str:
    """``text`` with a table renamed where it is defined or read; columns of that name stay."""
    return re.sub(rf"(?m)(^|,\n|\bFROM |\bJOIN |, )({name})(?= AS \(|\s|\)|$)(?! AS [a-z])", rf"\g<1>{new}", text)


MOVING = re.sub(
    r"(?m)(^|,\n|^WITH )(\w+) AS \(", r"\g<1>\g<2> AS MATERIALIZED (",
    with_(WORK, "state0 AS (SELECT id, course, title, date, start_time, end_time, source FROM stored0)", *map(_batch_sql, range(4))),
)


@query(
    "stream_reconcile",
    MOVING + " ".join(
        f"""{'UNION ALL' if k else ''} SELECT {k} AS batch, CASE v2 WHEN 'retimed' THEN 'moved' ELSE v2 END AS kind, count(*) AS n FROM step2_{k} WHERE v2 <> 'dropped' GROUP BY 2"""
        for k in range(4)
    ),
)
def stream_reconcile(t):
    """Verdicts of four batches, each against the table the batch before left."""
    out, _ = _moving(t)
    found = t.spark.read.option("basePath", out).parquet(out).withColumn("batch", F.col("batch").cast("int"))
    return found.groupBy("batch", "kind").agg(F.sum("n").alias("n"))


@query("stream_reconciled_table", MOVING + "SELECT * FROM state4")
def stream_reconciled_table(t):
    """The calendar after four batches of moves and new work."""
    return _moving(t)[1].read().select("id", "course", "title", "date", "start_time", "end_time", "source")


def _moving(t):
    spark = t.spark
    stored = reconcile.signed(stored_work(t.orders)).withColumn("bucket", F.expr("cast(pmod(hash(course), 8) AS int)"))
    table = VersionedTable(spark, shared_dir(spark, "calendar"), stored.schema, ["source", "bucket"])
    table.commit(0, stored, [tuple(r) for r in stored.select("source", "bucket").distinct().collect()])
    pulled = pulled_work(t.orders).withColumn("k", F.expr("pos div 2"))
    again = pulled.where(AGAIN).selectExpr(
        "* EXCEPT (pos, date)", "pos + 1000000000 AS pos", "date_add(date, cast(k % 4 AS int) + 1) AS date", "k % 4 + 1 AS file"
    )
    rows = pulled.withColumn("file", F.expr(FILE)).unionByName(again)
    items = materialize(rows.drop("k"), "pulled")
    polls, out = [items.where(f"file = {k}").drop("file") for k in range(4)], shared_dir(spark, "verdicts")
    J.run_parts(polls, J.reconcile_into(table, out, TODAY, "-1 - pos", buckets=8), "reconcile")
    return out, table
