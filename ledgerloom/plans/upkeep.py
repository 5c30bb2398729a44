"""Query keys of table maintenance."""

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import upkeep as U
from ledgerloom.plans.registry import query
from ledgerloom.plans.text_plans import LINKS, link_rows
from ledgerloom.plans.views import DEADLINES, with_
from ledgerloom.session import shared_dir
from ledgerloom.sources.tables import TERM_END, TERM_START, deadlines
from ledgerloom.sources.versions import VersionedTable

# ------------------------------------------------------------------ calendar sources

IMPORT = """parsed AS (SELECT o_orderkey AS pos, o_orderkey // 2 AS id, 'T' || o_custkey AS title, o_totalprice AS amount,
    CASE (o_orderkey // 2) % 3 WHEN 0 THEN 'ics' WHEN 1 THEN 'csv' ELSE 'recurring' END AS source,
    CASE WHEN (o_orderkey // 2) % 3 = 1 AND o_totalprice < 20000 THEN 'bad price' END AS error FROM orders),
existing AS (SELECT o_orderkey + 3 AS id, 'old ' || o_orderpriority AS title, o_totalprice AS amount,
    CASE (o_orderkey + 3) % 3 WHEN 0 THEN 'ics' WHEN 1 THEN 'csv' ELSE 'recurring' END AS source FROM orders),
good AS (SELECT id, title, amount, source FROM (SELECT *, row_number() OVER (PARTITION BY id, source ORDER BY pos DESC) AS rn FROM parsed WHERE error IS NULL) WHERE rn = 1)"""


@query(
    "rebuild_or_upsert",
    with_(IMPORT) + """SELECT * FROM good UNION ALL SELECT * FROM existing WHERE source IN (SELECT source FROM parsed WHERE error IS NOT NULL) AND id NOT IN (SELECT id FROM good)""",
)
def rebuild_or_upsert(t):
    source = "CASE ({0}) % 3 WHEN 0 THEN 'ics' WHEN 1 THEN 'csv' ELSE 'recurring' END"
    parsed = t.orders.selectExpr(
        "o_orderkey AS pos", "o_orderkey div 2 AS id", "concat('T', o_custkey) AS title", "o_totalprice AS amount",
        f"{source.format('o_orderkey div 2')} AS source",
        "if((o_orderkey div 2) % 3 = 1 AND o_totalprice < 20000, 'bad price', null) AS error",
    )
    existing = t.orders.selectExpr(
        "o_orderkey + 3 AS id", "concat('old ', o_orderpriority) AS title", "o_totalprice AS amount", f"{source.format('o_orderkey + 3')} AS source"
    )
    return U.rebuild_or_upsert(existing, parsed)


#: Three imports of the orders: one clean, one in which prices break a source, one in which that source has no good row and
#: another is gone.
IMPORTS = """rows0 AS (SELECT o_orderkey AS pos, o_orderkey // 2 AS id, 'T' || o_custkey AS title, o_totalprice AS amount,
    CASE (o_orderkey // 2) % 3 WHEN 0 THEN 'ics' WHEN 1 THEN 'csv' ELSE 'recurring' END AS source, n::INT AS batch FROM orders, range(3) t(n)),
parsed AS (SELECT pos, id, title || ' v' || batch AS title, amount + batch AS amount, source, batch,
    CASE WHEN source = 'csv' AND (batch = 1 AND amount < 20000 OR batch = 2) THEN 'bad price' WHEN source = 'ics' AND batch = 2 AND amount < 10000 THEN 'bad price' END AS error
  FROM rows0 WHERE pos % 4 <> batch AND NOT (source = 'recurring' AND batch = 2)),
good AS (SELECT id, title, amount, source, batch FROM (SELECT *, row_number() OVER (PARTITION BY id, source, batch ORDER BY pos DESC) AS rn FROM parsed WHERE error IS NULL) WHERE rn = 1),
broken AS (SELECT DISTINCT source, batch FROM parsed WHERE error IS NOT NULL)"""


def _import_sql(k: int) -> str:
    kept = f"""UNION ALL SELECT id, title, amount, source FROM version{k - 1} v WHERE source IN (SELECT source FROM broken WHERE batch = {k})
  AND NOT EXISTS (SELECT 1 FROM good g WHERE g.batch = {k} AND g.id = v.id)"""
    return f"version{k} AS (SELECT id, title, amount, source FROM good WHERE batch = {k} {kept if k else ''})"


@query(
    "commit_import",
    with_(IMPORTS, *map(_import_sql, range(3))) + " UNION ALL ".join(f"SELECT {k} AS version, * FROM version{k}" for k in range(3)),
)
def commit_import(t):
    """Three imports into one table, the second tried twice; every version read back."""
    spark = t.spark
    rows = t.orders.selectExpr(
        "o_orderkey AS pos", "o_orderkey div 2 AS id", "concat('T', o_custkey) AS title", "o_totalprice AS amount",
        "CASE (o_orderkey div 2) % 3 WHEN 0 THEN 'ics' WHEN 1 THEN 'csv' ELSE 'recurring' END AS source",
    )
    low = "source = 'csv' AND ({k} = 1 AND amount < 20000 OR {k} = 2) OR source = 'ics' AND {k} = 2 AND amount < 10000"
    table = VersionedTable(spark, shared_dir(spark, "imports"), rows.drop("pos").schema, ["source"])
    for k in (0, 1, 1, 2):
        parsed = rows.where(f"pos % 4 <> {k} AND NOT (source = 'recurring' AND {k} = 2)").selectExpr(
            "pos", "id", f"concat(title, ' v{k}') AS title", f"amount + {k} AS amount", "source", f"if({low.format(k=k)}, 'bad price', null) AS error"
        )
        U.commit_import(table, parsed, k)
    first, *others = (table.read(k).withColumn("version", F.lit(k)) for k in table.versions())
    for more in others:
        first = first.unionByName(more)
    return first


@query(
    "collapse_report",
    """SELECT source, count(*) AS parsed, count(DISTINCT id) AS stored, count(*) - count(DISTINCT id) AS collapsed FROM (
  SELECT CASE l_returnflag WHEN 'A' THEN 'ics' WHEN 'R' THEN 'csv' ELSE 'recurring' END AS source,
    substr(sha1(CASE l_returnflag WHEN 'A' THEN 'ics' WHEN 'R' THEN 'csv' ELSE 'recurring' END || '|S' || l_suppkey || '|' || l_linestatus || '|' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')), 1, 16) AS id
  FROM lineitem) GROUP BY source""",
)
def collapse_report(t):
    rows = t.lineitem.selectExpr(
        "CASE l_returnflag WHEN 'A' THEN 'ics' WHEN 'R' THEN 'csv' ELSE 'recurring' END AS source", "concat('S', l_suppkey) AS course",
        "l_linestatus AS title", "l_shipdate AS starts_at",
    )
    return U.collapse_report(rows.selectExpr("source", f"{X.event_id('source', 'course', 'title', 'starts_at')} AS id"))


RULES = """rules AS (SELECT s_suppkey AS rule_id, 'C' || (s_suppkey % 15) AS course, CASE s_suppkey % 4 WHEN 0 THEN [0, 2, 4] WHEN 1 THEN [1, 3] WHEN 2 THEN [0] ELSE [5, 6] END AS weekdays FROM supplier),
breaks AS (SELECT DATE '2024-01-08' + n_nationkey * 9 AS b0, DATE '2024-01-08' + n_nationkey * 9 + n_regionkey AS b1 FROM nation)"""


@query(
    "recurring_expand",
    with_(RULES) + f"""SELECT rule_id, course, 'Class ' || rule_id AS title, d + INTERVAL 9 HOUR AS starts_at, d + INTERVAL 590 MINUTE AS ends_at FROM rules,
(SELECT unnest(generate_series(TIMESTAMP '{TERM_START}', TIMESTAMP '{TERM_END}', INTERVAL 1 DAY)) AS d)
WHERE list_contains(weekdays, (isodow(d) - 1)::INT) AND NOT EXISTS (SELECT 1 FROM breaks WHERE d::DATE BETWEEN b0 AND b1)""",
)
def recurring_expand(t):
    rules = t.supplier.selectExpr(
        "s_suppkey AS rule_id", "concat('C', s_suppkey % 15) AS course", "concat('Class ', s_suppkey) AS title",
        "CASE s_suppkey % 4 WHEN 0 THEN array(0, 2, 4) WHEN 1 THEN array(1, 3) WHEN 2 THEN array(0) ELSE array(5, 6) END AS weekdays",
        "'09:00' AS start_time", "'09:50' AS end_time",
    )
    breaks = t.nation.selectExpr("date_add(date'2024-01-08', n_nationkey * 9) AS start", "date_add(date'2024-01-08', n_nationkey * 9 + n_regionkey) AS end")
    return U.expand_recurring(rules, breaks, TERM_START, TERM_END)


@query(
    "match_course",
    """WITH texts AS (SELECT p_partkey AS id, p_name || ' na-tion _' || (p_partkey % 40) || ' ' || p_type AS text FROM part),
m AS (SELECT t.id, n_name, row_number() OVER (PARTITION BY t.id ORDER BY length(regexp_replace(n_name, '[\\s_-]+', '', 'g')) DESC, n_name) AS rn
  FROM texts t JOIN nation ON contains(upper(regexp_replace(t.text, '[\\s_-]+', '', 'g')), upper(regexp_replace(n_name, '[\\s_-]+', '', 'g'))))
SELECT texts.id, coalesce(n_name, 'OTHER') AS course FROM texts LEFT JOIN m ON m.id = texts.id AND rn = 1""",
)
def match_course(t):
    texts = t.part.selectExpr("p_partkey AS id", "concat(p_name, ' na-tion _', p_partkey % 40, ' ', p_type) AS text")
    return U.match_course(texts, t.nation.selectExpr("n_name AS code"))


FETCHES = """fetches AS (SELECT user_id AS feed, ts AS fetched_at, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN '<html>' || event_id WHEN 'view' THEN '  begin:vcalendar' || chr(10) || event_id
  ELSE 'BEGIN:VCALENDAR' || chr(10) || event_id END AS body FROM events)"""


@query(
    "feed_last_good",
    with_(FETCHES) + """SELECT f.feed, g.body, g.fetched_at AS good_at, f.checked_at, g.body IS NULL OR g.fetched_at < f.checked_at AS stale
FROM (SELECT feed, max(fetched_at) AS checked_at FROM fetches GROUP BY feed) f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY fetched_at DESC) AS rn FROM fetches
  WHERE body IS NOT NULL AND upper(ltrim(body)) LIKE 'BEGIN:VCALENDAR%') g ON g.feed = f.feed AND rn = 1""",
)
def feed_last_good(t):
    return U.feed_last_good(
        t.events.selectExpr(
            "user_id AS feed", "ts AS fetched_at",
            "CASE event_type WHEN 'error' THEN null WHEN 'click' THEN concat('<html>', event_id) WHEN 'view' THEN concat('  begin:vcalendar\\n', event_id)"
            " ELSE concat('BEGIN:VCALENDAR\\n', event_id) END AS body",
        )
    )


# ------------------------------------------------------------------ notes and links

SLUG = r"coalesce(nullif(regexp_replace(substr(lower(regexp_replace(regexp_replace(left(text, 40), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 48), '-+$', ''), ''), 'announcement')"


def notes(t):
    return t.documents.selectExpr("doc_id AS id", "source AS course", "left(text, 40) AS name", "text")


@query(
    "note_status",
    f"""WITH s AS (SELECT doc_id AS id, source AS course, {SLUG} AS slug FROM documents)
SELECT id, course, course || '/_synced/quizzes/' || slug || CASE WHEN id = min(id) OVER (PARTITION BY course, slug) THEN '' ELSE '-' || id END || '.md' AS path,
CASE id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'updated' ELSE 'unchanged' END AS status FROM s""",
)
def note_status(t):
    """Against files of which some are missing and some hold other text."""
    held = U.note_paths(notes(t)).selectExpr(
        "if(id % 4 = 0, concat(path, '.gone'), path) AS path", "if(id % 4 = 1, concat(text, '!'), text) AS text"
    )
    return U.note_status(notes(t), held)


@query(
    "pending_links",
    with_(LINKS) + """SELECT page_id, title, kind, url, fetch_url, ext, dest, substr(sha1(url), 1, 16) AS link_id FROM links
WHERE session IN ('google', 'sharepoint') AND page_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def pending_links(t):
    links = link_rows(t)
    imported = links.join(t.labels.where("quality = 1").selectExpr("doc_id AS page_id"), "page_id", "left_semi")
    return U.pending_links(links, imported).drop("session")


SCANS = """scans AS (SELECT page_id, 'web/' || page_id || '.html' AS path, CASE page_id % 5 WHEN 0 THEN '<html><img class="a" src="scan' || page_id || '.png"></html>'
  WHEN 1 THEN '<img src=''http://x.org/a.png''>' ELSE html END AS html FROM pages)"""


@query(
    "scan_candidates",
    with_(SCANS) + """SELECT path, 'scan' || page_id || '.png' AS image FROM scans WHERE page_id % 5 = 0 AND page_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)""",
)
def scan_candidates(t):
    """Transcripts exist for labelled pages; those of toxic ones are out of date."""
    pages = t.pages.selectExpr(
        "concat('web/', page_id, '.html') AS path",
        "CASE page_id % 5 WHEN 0 THEN concat('<html><img class=\"a\" src=\"scan', page_id, '.png\"></html>') WHEN 1 THEN \"<img src='http://x.org/a.png'>\" ELSE html END AS html",
        "timestamp_ntz'2024-01-10 00:00:00' AS mtime",
    )
    done = t.labels.where("quality = 1").selectExpr(
        "concat('web/', doc_id, '.html') AS path", "if(toxic = 0, timestamp_ntz'2024-01-10 00:00:00', timestamp_ntz'2024-01-01 00:00:00') AS mtime"
    )
    return U.scan_candidates(pages, done)


@query("scanned_documents", "SELECT doc_id FROM documents WHERE n_chars < 100 AND length(lang) > 0")
def scanned_documents(t):
    return U.scanned_documents(t.documents.selectExpr("doc_id", "n_chars AS chars", "length(lang) AS images", "1 AS pages")).select("doc_id")


# ------------------------------------------------------------------ last-good data and de-duplication

GOOD = """fresh AS (SELECT user_id AS tenant, event_type AS course, max(value) AS pct FROM events WHERE ts >= TIMESTAMP '2024-01-28' AND event_type IN ('purchase', 'signup') GROUP BY ALL),
previous AS (SELECT user_id AS tenant, event_type AS course, max(value) AS pct FROM events WHERE ts < TIMESTAMP '2024-01-28' AND event_type IN ('purchase', 'signup') GROUP BY ALL),
errors AS (SELECT DISTINCT user_id AS tenant FROM events WHERE ts >= TIMESTAMP '2024-01-28' AND event_type IN ('error', 'view'))"""


@query(
    "keep_last_good",
    with_(GOOD) + """SELECT *, false AS stale FROM fresh UNION ALL SELECT *, true FROM previous WHERE tenant IN (SELECT tenant FROM errors) AND tenant NOT IN (SELECT tenant FROM fresh)""",
)
def keep_last_good(t):
    late, early = "ts >= timestamp_ntz'2024-01-28 00:00:00'", "ts < timestamp_ntz'2024-01-28 00:00:00'"
    grades = lambda when: t.events.where(when).where("event_type IN ('purchase', 'signup')").groupBy(
        F.col("user_id").alias("tenant"), F.col("event_type").alias("course")
    ).agg(F.max("value").alias("pct"))
    errors = t.events.where(late).where("event_type IN ('error', 'view')").selectExpr("user_id AS tenant")
    return U.keep_last_good(grades(late), grades(early), errors)


@query(
    "unseen_items",
    """WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-08')
SELECT event_id, user_id, event_type FROM events e WHERE ts >= TIMESTAMP '2024-01-08' AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND s.event_type = e.event_type)""",
)
def unseen_items(t):
    split = "timestamp_ntz'2024-01-08 00:00:00'"
    return U.unseen(t.events.where(f"ts >= {split}"), t.events.where(f"ts < {split}"), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query(
    "override_union",
    """WITH b AS (SELECT 0 AS priority, p_partkey AS pos, p_name || ' ' || (p_partkey % 97) AS name, p_retailprice AS price FROM part WHERE p_size <= 25
  UNION ALL SELECT 1, p_partkey, upper(p_name || ' ' || (p_partkey % 97)), p_retailprice FROM part WHERE p_size > 25)
SELECT name, price, priority = 1 AS own FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY priority DESC, pos DESC) AS rn FROM b) WHERE rn = 1""",
)
def override_union(t):
    rows = t.part.selectExpr("p_partkey AS pos", "concat(p_name, ' ', p_partkey % 97) AS name", "p_retailprice AS price", "p_size")
    own = rows.where("p_size > 25").withColumn("name", F.upper("name"))
    return U.override_union(rows.where("p_size <= 25").drop("p_size"), own.drop("p_size"))


@query(
    "feed_dedup",
    with_(DEADLINES) + """, e AS (SELECT id % 3 AS feed_rank, id AS pos, CASE id % 3 WHEN 0 THEN title WHEN 1 THEN upper(title) || '!' ELSE replace(title, ' ', ' - ') END AS title,
  date_trunc('day', starts_at)::TIMESTAMP AS starts_at FROM deadlines)
SELECT starts_at, title, feed_rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY starts_at, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') ORDER BY feed_rank, pos) AS rn FROM e) WHERE rn = 1""",
)
def feed_dedup(t):
    feeds = deadlines(t.events).selectExpr(
        "id % 3 AS feed_rank", "id AS pos", "CASE id % 3 WHEN 0 THEN title WHEN 1 THEN concat(upper(title), '!') ELSE replace(title, ' ', ' - ') END AS title",
        "cast(cast(starts_at AS date) AS timestamp_ntz) AS starts_at",
    )
    return U.feed_dedup(feeds)


NOTIFIED = "seen AS (SELECT 'i|' || user_id || '|' || event_type || '|' || (props->>'$.k') AS key, max(ts)::DATE AS day FROM events GROUP BY 1)"


@query("notified_prune", with_(NOTIFIED) + "SELECT key, day FROM seen WHERE day >= DATE '2024-01-25' - 10 ORDER BY day DESC, key LIMIT 300")
def notified_prune(t):
    seen = t.events.groupBy(F.expr("concat_ws('|', 'i', user_id, event_type, get_json_object(props, '$.k')) AS key")).agg(F.expr("cast(max(ts) AS date) AS day"))
    return U.notified_prune(seen, "2024-01-25", keep_days=10, max_keys=300)


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= '2000-01-01'")
def set_difference(t):
    recent = t.orders.where("o_orderdate >= timestamp_ntz'2000-01-01 00:00:00'").selectExpr("o_custkey AS c_custkey")
    return t.customer.select("c_custkey").join(recent, "c_custkey", "left_anti").distinct()


@query("set_intersection", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate >= '2000-01-01'")
def set_intersection(t):
    recent = t.orders.where("o_orderdate >= timestamp_ntz'2000-01-01 00:00:00'").selectExpr("o_custkey AS c_custkey")
    return t.customer.select("c_custkey").join(recent, "c_custkey", "left_semi").distinct()


# ------------------------------------------------------------------ run reports

@query(
    "sync_status",
    """WITH s AS (SELECT ts::DATE AS run_id, user_id % 4 AS site, count(*) FILTER (event_type = 'error' AND value > 20) = 0 AS ok, count(*) FILTER (event_type = 'click') AS new,
  count(*) FILTER (event_type = 'view') AS moved FROM events GROUP BY ALL)
SELECT run_id, count(*) AS sites, bool_or(ok) AS ok, count(*) FILTER (NOT ok) AS failed_sites, coalesce(sum(new) FILTER (ok), 0)::BIGINT AS total_new, coalesce(sum(moved) FILTER (ok), 0)::BIGINT AS total_moved
FROM s GROUP BY run_id""",
)
def sync_status(t):
    sites = t.events.groupBy(F.expr("cast(ts AS date) AS run_id"), F.expr("user_id % 4 AS site")).agg(
        F.expr("count_if(event_type = 'error' AND value > 20) = 0 AS ok"), F.expr("count_if(event_type = 'click') AS new"),
        F.expr("count_if(event_type = 'view') AS moved"),
    )
    return U.sync_status(sites)


@query(
    "error_kinds",
    """WITH l AS (SELECT user_id % 7 AS source, event_id AS line_no, event_type, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id DESC) AS rn FROM events)
SELECT source, CASE event_type WHEN 'error' THEN 'ValueError' WHEN 'signup' THEN 'Traceback' WHEN 'purchase' THEN 'LoginRequired' ELSE 'an error (see the log)' END AS kind,
count(*) AS n, max(line_no) AS last_line FROM l WHERE rn <= 400 AND event_type <> 'view' GROUP BY ALL""",
)
def error_kinds(t):
    log = t.events.selectExpr(
        "user_id % 7 AS source", "event_id AS line_no",
        "CASE event_type WHEN 'error' THEN concat('ERROR ValueError: secret ', value) WHEN 'signup' THEN 'Traceback (most recent call last):'"
        " WHEN 'purchase' THEN concat('ERROR LoginRequired for user ', user_id) WHEN 'click' THEN concat('ERROR disk full ', value) ELSE 'INFO fine' END AS line",
    )
    return U.error_kinds(log)
