"""Query keys of the ingest jobs. Payloads are serialized from whole tables; the oracles use the tables directly."""

from pyspark.sql import functions as F

from ledgerloom.operators import upkeep as U
from ledgerloom.plans.registry import oracle_of, query
from ledgerloom.plans.text_plans import SITE_KIND_SQL
from ledgerloom.plans.views import with_
from ledgerloom.sources import calendars as C
from ledgerloom.sources import payloads as P

TODAY, CAP = "1998-03-01", "1998-09-20"
WINDOW = f"{{0}} BETWEEN DATE '{TODAY}' - 30 AND least(DATE '{TODAY}' + 240, DATE '{CAP}')"
ISO_Z = "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
NY = "({0} AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
LOCATION = "oaks|d2l|brightspace|connect|smartbook|vhl|supersite|blended|in.?class|en clase|in person|mct|my conversation trainer|talk abroad|zoom|lockdown|respondus|dropbox"
where_sql = lambda title, w: f"CASE WHEN regexp_matches({title}, '(?i)\\b({LOCATION})\\b') THEN {title} ELSE {title} || ' ({w})' END"

# ------------------------------------------------------------------ deadline csv


def csv_files(t):
    """One file per order with a row, blank lines and a row whose title has a line break; some rows and some headers are wrong."""
    row = (
        "CASE o_orderkey % 12 WHEN 0 THEN concat('F1,,', d, ',09:00,,false,quiz') WHEN 1 THEN 'F1,Quiz,not-a-date,09:00,,false,quiz'"
        " WHEN 2 THEN concat('F1,Quiz,', d, ',09:00,,false,homework') WHEN 3 THEN concat('F1,Quiz,', d, ',,,false,quiz')"
        " WHEN 4 THEN concat('F1,Quiz,', d, ',25:00,,no,exam') WHEN 5 THEN concat('F1,Quiz,', d, ',10:30,9:30,false,exam')"
        " WHEN 6 THEN concat('F', o_custkey % 10, ',Reading day,', d, ',,,TRUE,Admin')"
        " ELSE concat('F', o_custkey % 10, ',\"Quiz, part ', o_orderkey, '\",', d, ',9:05,10:45,0,project') END"
    )
    header = "if(o_custkey % 10 = 3, 'course,title,date', 'Course,title,date,start_time, end_time,all_day,kind')"
    second = "concat('F2,\"Two\r\nlines \"\"', o_orderkey, '\"\"\",', d, ',,,1,exam')"
    return t.orders.withColumn("d", F.expr("date_format(o_orderdate, 'yyyy-MM-dd')")).selectExpr(
        "o_orderkey AS file", f"concat('\ufeff', {header}, '\r\n', {row}, '\r\n\r\n', {second}, '\n\n') AS text"
    )


@query(
    "csv_validate",
    """WITH r AS (SELECT o_orderkey::VARCHAR AS file, o_orderkey % 12 AS m, o_custkey % 10 AS f, o_orderkey AS k, o_orderdate AS d FROM orders)
SELECT file, 2 AS line_no, CASE WHEN f = 3 THEN 'header must be exactly course,title,date,start_time,end_time,all_day,kind' ELSE CASE m WHEN 0 THEN 'course and title are required' WHEN 1 THEN 'date not-a-date is not a date'
  WHEN 2 THEN 'kind homework is not one of exam|project|quiz|admin' WHEN 3 THEN 'all_day is false but start_time is empty' WHEN 4 THEN 'time 25:00 is not a time' WHEN 5 THEN 'end_time 9:30 is not after start_time 10:30' END END AS error,
  CASE WHEN m = 0 THEN '' WHEN m < 6 THEN 'Quiz' WHEN m = 6 THEN 'Reading day' ELSE 'Quiz, part ' || k END AS title, m = 6 AS all_day,
  CASE WHEN f = 3 OR m < 6 THEN NULL WHEN m = 6 THEN d ELSE d + INTERVAL 545 MINUTE END AS starts_at, CASE WHEN f <> 3 AND m > 6 THEN d + INTERVAL 645 MINUTE END AS ends_at FROM r
UNION ALL SELECT file, 3, CASE WHEN f = 3 THEN 'header must be exactly course,title,date,start_time,end_time,all_day,kind' END, 'Two' || chr(13) || chr(10) || 'lines "' || k || '"', true,
  CASE WHEN f <> 3 THEN d END, NULL FROM r""",
)
def csv_validate(t):
    return C.deadline_csv(csv_files(t)).select("file", "line_no", "error", "title", "all_day", "starts_at", "ends_at")


@query(
    "rule_validate",
    """WITH r AS (SELECT s_suppkey AS k, s_suppkey % 6 AS m FROM supplier)
SELECT k AS rule_id, CASE WHEN m IN (0, 5) THEN '0,2' END AS weekdays, CASE m WHEN 0 THEN 'recurring' WHEN 4 THEN 'party' ELSE 'quiz' END AS kind,
CASE m WHEN 1 THEN 'unknown weekday' WHEN 2 THEN 'end time 09:00 is not after start 10:00' WHEN 3 THEN 'unreadable time' WHEN 4 THEN 'unknown kind party' END AS error FROM r""",
)
def rule_validate(t):
    rules = t.supplier.selectExpr(
        "s_suppkey AS rule_id", "'C1' AS course", "s_name AS title", "if(s_suppkey % 6 = 1, array('Mon', 'Mittwoch'), array('Wed', ' Monday', 'mon')) AS weekdays",
        "if(s_suppkey % 6 = 2, '10:00', if(s_suppkey % 6 = 3, '8 am', '08:00')) AS start_time", "'09:00' AS end_time",
        "CASE s_suppkey % 6 WHEN 0 THEN null WHEN 4 THEN 'party' ELSE 'quiz' END AS kind",
    )
    return C.validate_rules(rules).selectExpr("rule_id", "array_join(weekdays, ',') AS weekdays", "kind", "error")


# ------------------------------------------------------------------ iCalendar


def ics_bodies(t):
    """One calendar body per event with two VEVENTs in the several ways calendars write them."""
    day = "date_format(ts, 'yyyyMMdd')"
    stamp = "date_format(ts, \"yyyyMMdd'T'HHmmss\")"
    v = (
        f"CASE event_id % 5 WHEN 0 THEN concat('SUMMARY:All day ', event_id, '\\r\\nDTSTART;VALUE=DATE:', {day}, '\\r\\nDTEND;VALUE=DATE:', date_format(date_add(ts, 2), 'yyyyMMdd'))"
        f" WHEN 1 THEN concat('BEGIN:VALARM\\r\\nSUMMARY:Alarm!\\r\\nDURATION:PT5M\\r\\nEND:VALARM\\r\\nSUMMARY:Zulu ', event_id, '\\r\\nDTSTART:', {stamp}, 'Z\\r\\nDURATION:PT1H30M')"
        f" WHEN 2 THEN concat('DTSTART;TZID=Europe/Berlin:', {stamp}, '\\r\\nDTEND;TZID=Europe/Berlin:', date_format(ts + INTERVAL '2' HOUR, \"yyyyMMdd'T'HHmmss\"))"
        f" WHEN 3 THEN concat('SUMMARY:Lost ', event_id) ELSE concat('SUMMARY:Very long na\\r\\n me ', event_id, '\\\\, folded\\r\\nCATEGORIES:C', user_id, '\\r\\nDTSTART:', {stamp}) END"
    )
    return t.events.selectExpr(
        "event_id AS feed",
        f"concat('BEGIN:VCALENDAR\\r\\nBEGIN:VEVENT\\r\\n', {v}, '\\r\\nEND:VEVENT\\r\\nBEGIN:VEVENT\\r\\nSUMMARY:Twin\\r\\nDTSTART;TZID=Pacific Standard Time:20240201T100000\\r\\nDTEND;TZID=\"Pacific Standard Time\":20240201T110000\\r\\nRRULE:FREQ=WEEKLY\\r\\nEXDATE;TZID=America/Los_Angeles:20240208T100000,20240215T100000\\r\\nEND:VEVENT\\r\\nBEGIN:VEVENT\\r\\nSUMMARY:Odd\\r\\nDTSTART;TZID=Mars/Olympus:20240201T100000\\r\\nEND:VEVENT\\r\\nEND:VCALENDAR') AS body",
    )


@query(
    "ics_events",
    """WITH e AS (SELECT event_id AS feed, event_id % 5 AS m, user_id, date_trunc('second', ts)::TIMESTAMP AS s, ts::DATE AS d FROM events)
SELECT feed, 0 AS n, CASE m WHEN 0 THEN 'All day ' || feed WHEN 1 THEN 'Zulu ' || feed WHEN 2 THEN '(untitled)' WHEN 3 THEN 'Lost ' || feed ELSE 'Very long name ' || feed || ', folded' END AS title,
  CASE WHEN m = 4 THEN 'C' || user_id ELSE '' END AS categories,
  CASE m WHEN 0 THEN d::TIMESTAMP WHEN 1 THEN s - INTERVAL 5 HOUR WHEN 2 THEN s - INTERVAL 6 HOUR WHEN 4 THEN s END AS starts_at,
  CASE m WHEN 0 THEN (d + 1)::TIMESTAMP WHEN 1 THEN s - INTERVAL 210 MINUTE WHEN 2 THEN s - INTERVAL 4 HOUR END AS ends_at, m = 0 AS all_day,
  CASE WHEN m = 3 THEN 'VEVENT Lost ' || feed || ' has no DTSTART; skipped' END AS error FROM e
UNION ALL SELECT feed, 1, 'Twin', '', TIMESTAMP '2024-02-01 13:00:00', TIMESTAMP '2024-02-01 14:00:00', false, NULL FROM e
UNION ALL SELECT feed, 2, 'Odd', '', NULL, NULL, false, 'VEVENT Odd: unknown time zone' FROM e""",
)
def ics_events(t):
    return C.ics_events(ics_bodies(t), "America/New_York").drop("rrule", "rdates", "exdates")


@query(
    "ics_occurrences",
    """SELECT event_id AS feed, 'Twin' AS title, TIMESTAMP '2024-02-01 13:00:00' + to_days(7 * w) AS starts_at FROM events, unnest([0, 3, 4]) u(w)""",
)
def ics_occurrences(t):
    """Feed to occurrences: the cancelled dates carry a zone of their own."""
    twins = C.ics_events(ics_bodies(t), "America/New_York").where("title = 'Twin'")
    return C.expand_rules(twins, "2024-01-01", "2024-03-01", zone="America/New_York").select("feed", "title", "starts_at")


# The oracle lists the days of a calendar and says of each, in words of the calendar, whether it is one of the rule's.
RRULE = """r AS (SELECT c_custkey AS id, c_custkey % 16 AS m, DATE '2023-11-20' + (c_custkey % 61)::INT AS d0 FROM customer),
cal0 AS (SELECT unnest(generate_series(DATE '2023-01-01', DATE '2024-12-31', INTERVAL 1 DAY))::DATE AS d),
cal AS (SELECT d, row_number() OVER (PARTITION BY date_trunc('month', d), isodow(d) ORDER BY d) AS nth, row_number() OVER (PARTITION BY date_trunc('month', d), isodow(d) ORDER BY d DESC) AS nth_last,
  row_number() OVER (PARTITION BY date_trunc('month', d), isodow(d) < 6 ORDER BY d DESC) AS work_last, date_diff('week', DATE '2023-01-01', d) AS iso_week, (d - DATE '2023-01-01') // 7 AS sun_week FROM cal0),
c AS (SELECT id, m, d0, cal.d, row_number() OVER (PARTITION BY id ORDER BY cal.d) AS i FROM r JOIN cal ON cal.d >= d0 JOIN cal z ON z.d = d0 WHERE
  (m = 0 AND (cal.d - d0) % 3 = 0) OR (m = 1 AND isodow(cal.d) IN (1, 3, 5) AND cal.d <= DATE '2024-03-01') OR (m = 2 AND day(cal.d) = day(d0))
  OR (m = 3 AND isodow(cal.d) = isodow(d0) AND (cal.d - d0) % 14 = 0) OR (m = 4 AND cal.d = d0)
  OR (m = 5 AND day(cal.d) = day(d0) AND month(cal.d) = month(d0)) OR (m = 7 AND isodow(cal.d) = 2 AND cal.nth = 2) OR (m = 8 AND isodow(cal.d) = 5 AND cal.nth_last = 1)
  OR (m = 9 AND (day(cal.d) = 15 OR cal.d = last_day(cal.d))) OR (m = 10 AND isodow(cal.d) < 6 AND cal.work_last = 1)
  OR (m = 11 AND isodow(cal.d) IN (2, 7) AND (cal.sun_week - z.sun_week) % 2 = 0) OR (m = 12 AND isodow(cal.d) IN (2, 7) AND (date_trunc('week', cal.d)::DATE - date_trunc('week', d0)::DATE) % 14 = 0)
  OR (m = 13 AND month(cal.d) = 3 AND isodow(cal.d) = 7 AND cal.nth = 2) OR (m = 14 AND (isodow(cal.d) = 1 OR day(cal.d) = 13))),
o AS (SELECT id, d FROM c WHERE (m <> 0 OR i <= 20) AND (m <> 2 OR i <= 6) AND (m <> 3 OR d <> d0 + 28) AND (m = 4 OR d >= DATE '2024-01-08') AND (m = 4 OR d <= DATE '2024-05-03')
  UNION SELECT id, DATE '2024-02-14' FROM r WHERE m = 3 AND d0 + 28 <> DATE '2024-02-14')"""


def rule_events(t):
    rules = {
        0: "FREQ=DAILY;INTERVAL=3;COUNT=20", 1: "FREQ=WEEKLY;BYDAY=MO,WE,FR;UNTIL=20240301T235959", 2: "FREQ=MONTHLY;COUNT=6", 3: "FREQ=WEEKLY;INTERVAL=2",
        5: "FREQ=YEARLY", 6: "FREQ=DAILY;UNTIL=20230101", 7: "FREQ=MONTHLY;BYDAY=2TU", 8: "FREQ=MONTHLY;BYDAY=-1FR", 9: "FREQ=MONTHLY;BYMONTHDAY=15,-1",
        10: "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1", 11: "FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,SU;WKST=SU", 12: "FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,SU",
        13: "FREQ=YEARLY;BYMONTH=3;BYDAY=2SU", 14: "FREQ=WEEKLY;BYDAY=MO\\nFREQ=MONTHLY;BYMONTHDAY=13", 15: "FREQ=HOURLY;COUNT=3",
    }
    whens = " ".join(f"WHEN {m} THEN '{rule}'" for m, rule in rules.items())
    return t.customer.selectExpr(
        "c_custkey AS id", "c_custkey % 16 AS m", "cast(date_add(date'2023-11-20', cast(c_custkey % 61 AS int)) AS timestamp_ntz) + INTERVAL '10' HOUR AS starts_at"
    ).selectExpr(
        "id", "starts_at", "starts_at + INTERVAL '75' MINUTE AS ends_at", f"CASE m {whens} END AS rrule",
        "if(m = 3, array(timestamp_ntz'2024-02-14 10:00:00', timestamp_ntz'2023-02-14 10:00:00'), cast(array() AS array<timestamp_ntz>)) AS rdates",
        "if(m = 3, array(starts_at + INTERVAL '28' DAY), cast(array() AS array<timestamp_ntz>)) AS exdates", "cast(null AS string) AS error",
    )


@query(
    "rrule_expand",
    with_(RRULE) + """SELECT r.id, d + INTERVAL 10 HOUR AS starts_at, d + INTERVAL 675 MINUTE AS ends_at, CASE WHEN m = 15 THEN 'unsupported rule FREQ=HOURLY;COUNT=3'
  WHEN o.id IS NULL THEN 'recurs but has no occurrence inside 2024-01-08..2024-05-03' END AS error FROM r LEFT JOIN o ON o.id = r.id""",
)
def rrule_expand(t):
    return C.expand_rules(rule_events(t), "2024-01-08", "2024-05-03")


# ------------------------------------------------------------------ learning-site payloads


@query(
    "enrollment_map",
    """SELECT c_custkey AS tenant, c_custkey * 10 + i AS ou_id, 'FINC' || (300 + c_nationkey) AS course FROM customer, range(2) r(i)
WHERE 300 + c_nationkey <= 315 AND ((i = 0 AND c_custkey % 3 <> 0) OR (i = 1 AND c_custkey % 4 = 0))""",
)
def enrollment_map(t):
    item = (
        "struct(struct(c_custkey * 10 + {i} AS Id, concat('{name} (finc-', 300 + c_nationkey, '-01) ', {term}) AS Name, struct({type} AS Code) AS Type) AS OrgUnit)"
    )
    first = item.format(i=0, name="Finance", term="if(c_custkey % 3 = 0, '1997 Fall', '1998 Spring')", type="'Course Offering'")
    second = item.format(i=1, name="Honors", term="'1998 Spring'", type="if(c_custkey % 4 = 0, 'Course Offering', 'Group')")
    raw = t.customer.selectExpr("c_custkey AS tenant", f"to_json(struct(array({first}, {second}) AS Items)) AS payload")
    courses = t.nation.where("n_nationkey <= 15").selectExpr("concat('FINC', 300 + n_nationkey) AS course")
    return P.enrollments(raw, courses, TODAY)


EVENT_NAME = "CASE k % 5 WHEN 0 THEN 'Proctoring Enabled: Midterm ' || k WHEN 1 THEN 'Office hours ' || k WHEN 2 THEN 'Zoom quiz ' || k WHEN 3 THEN '' ELSE 'Reading ' || k END"
SITE_EVENTS = f"""ev0 AS (SELECT o_orderkey AS k, 'C' || (o_custkey % 9) AS course, o_orderdate + to_hours(o_orderkey % 24) AS s, o_orderkey % 8 = 0 AS all_day, {EVENT_NAME} AS name
  FROM (SELECT *, o_orderkey AS k FROM orders)),
ev AS (SELECT *, regexp_replace(name, '^Proctoring Enabled: ', '') AS title, {NY.format('s')} AS l, {NY.format('(s + INTERVAL 3 HOUR)')} AS e FROM ev0)"""


def event_payloads(t):
    name = "CASE o_orderkey % 5 WHEN 0 THEN concat('Proctoring Enabled: Midterm ', o_orderkey) WHEN 1 THEN concat('Office hours ', o_orderkey) WHEN 2 THEN concat('Zoom quiz ', o_orderkey) WHEN 3 THEN '' ELSE concat('Reading ', o_orderkey) END"
    s = "o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 AS int))"
    return t.orders.selectExpr(
        "concat('C', o_custkey % 9) AS course",
        f"to_json(array(struct({name} AS Title, {ISO_Z.format(s)} AS StartDateTime, {ISO_Z.format(s + ' + INTERVAL 3 HOUR')} AS EndDateTime, o_orderkey % 8 = 0 AS IsAllDayEvent,"
        " o_orderkey % 2 = 0 AS IsRecurring, o_orderkey AS CalendarEventId, 'extra' AS Color))) AS payload",
    )


@query(
    "pulled_events",
    with_(SITE_EVENTS) + f"""SELECT course, {where_sql('title', 'details on OAKS')} AS title, l::DATE AS date, CASE WHEN all_day THEN '' ELSE strftime(l, '%H:%M') END AS start_time,
CASE WHEN NOT all_day AND e::DATE = l::DATE THEN strftime(e, '%H:%M') ELSE '' END AS end_time, all_day, {SITE_KIND_SQL} AS kind, k::VARCHAR AS external_id
FROM ev WHERE title <> '' AND {WINDOW.format('l::DATE')} AND NOT ({SITE_KIND_SQL} = 'admin' AND k % 2 = 0)""",
)
def pulled_events(t):
    return P.calendar_events(event_payloads(t), TODAY, CAP)


def quizzes_payloads(t):
    """Every seventh quiz states no due date and so gives no row."""
    s = "o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 AS int))"
    raw = t.orders.selectExpr(
        "concat('C', o_custkey % 9) AS course",
        f"to_json(array(struct(o_orderkey AS QuizId, concat('Prueba ', o_orderkey) AS Name, if(o_orderkey % 7 = 0, null, {ISO_Z.format(s)}) AS DueDate,"
        f" {ISO_Z.format(s + ' - INTERVAL 2 DAY')} AS StartDate, if(o_orderkey % 3 = 0, {ISO_Z.format(s + ' + INTERVAL 90 MINUTE')}, null) AS EndDate))) AS payload",
    )
    return raw


@query(
    "pulled_quizzes",
    f"""WITH q AS (SELECT o_orderkey AS k, 'C' || (o_custkey % 9) AS course, {NY.format('(o_orderdate + to_hours(o_orderkey % 24))')} AS due, {NY.format('(o_orderdate + to_hours(o_orderkey % 24) - INTERVAL 2 DAY)')} AS st,
  CASE WHEN o_orderkey % 3 = 0 THEN {NY.format('(o_orderdate + to_hours(o_orderkey % 24) + INTERVAL 90 MINUTE)')} END AS en, 'Prueba ' || o_orderkey AS title FROM orders WHERE o_orderkey % 7 <> 0)
SELECT course, title || ' (on OAKS)' AS title, due::DATE AS date, strftime(due, '%H:%M') AS start_time, 'quiz' AS kind, 'quiz-' || k AS external_id,
array_to_string(list_sort(list_distinct(list_filter([strftime(st, '%H:%M'), strftime(due, '%H:%M'), strftime(en, '%H:%M')], lambda x: x IS NOT NULL))), ',') AS known_times,
array_to_string(list_sort(list_distinct(list_filter([strftime(st, '%Y-%m-%d'), strftime(due, '%Y-%m-%d'), strftime(en, '%Y-%m-%d')], lambda x: x IS NOT NULL))), ',') AS known_dates
FROM q WHERE {WINDOW.format('due::DATE')}""",
)
def pulled_quizzes(t):
    return P.quizzes(quizzes_payloads(t), TODAY, CAP).withColumn("known_times", F.array_join("known_times", ",")).withColumn(
        "known_dates", F.expr("array_join(transform(known_dates, d -> cast(d AS string)), ',')")
    )


def dropboxes_payloads(t):
    raw = t.orders.selectExpr(
        "concat('C', o_custkey % 9) AS course",
        f"to_json(array(struct(o_orderkey AS Id, concat('Memo ', o_orderkey) AS Name, if(o_orderkey % 6 = 0, null, {ISO_Z.format('o_orderdate + INTERVAL 239 MINUTE + INTERVAL 59 SECOND')}) AS DueDate))) AS payload",
    )
    return raw


@query(
    "pulled_dropboxes",
    f"""WITH q AS (SELECT o_orderkey AS k, 'C' || (o_custkey % 9) AS course, {NY.format('(o_orderdate + INTERVAL 239 MINUTE + INTERVAL 59 SECOND)')} AS due FROM orders WHERE o_orderkey % 6 <> 0)
SELECT course, 'Memo ' || k || ' (submit on OAKS)' AS title, due::DATE AS date, strftime(due, '%H:%M') AS start_time, 'project' AS kind, 'dropbox-' || k AS external_id FROM q WHERE {WINDOW.format('due::DATE')}""",
)
def pulled_dropboxes(t):
    return P.dropboxes(dropboxes_payloads(t), TODAY, CAP)


@query(
    "pulled_all",
    f"""SELECT 'oaks_events' AS site, course, title, date, start_time, kind, external_id FROM ({oracle_of("pulled_events")})
UNION ALL SELECT 'oaks_quizzes', course, title, date, start_time, kind, external_id FROM ({oracle_of("pulled_quizzes")})
UNION ALL SELECT 'oaks_dropbox', course, title, date, start_time, kind, external_id FROM ({oracle_of("pulled_dropboxes")})""",
)
def pulled_all(t):
    """Three sites through the registry."""
    tables = {"oaks_events": event_payloads, "oaks_quizzes": quizzes_payloads, "oaks_dropbox": dropboxes_payloads}
    found = P.pull({site: {"payloads": payloads(t)} for site, payloads in tables.items()}, TODAY, CAP)
    return found.select("site", "course", "title", "date", "start_time", "kind", "external_id")


@query(
    "pulled_assignments",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, n_nationkey, s_suppkey, {NY.format("(l_shipdate + to_hours(l_linenumber))")} AS due FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'NATION' || n_nationkey ELSE 'NATION' || n_nationkey END AS course, 'Chapter ' || l_partkey || ' (on Connect)' AS title, due::DATE AS date, strftime(due, '%H:%M') AS start_time, 'quiz' AS kind,
l_orderkey || '-' || l_linenumber || '-' || l_partkey AS external_id FROM a WHERE {WINDOW.format('due::DATE')} AND n_nationkey <= 19""",
)
def pulled_assignments(t):
    """Sections name their course themselves or through their parent; nations past 19 are not configured."""
    sections = t.supplier.selectExpr(
        "to_json(array(struct(s_suppkey AS id, s_nationkey AS course, if(s_suppkey % 2 = 0, concat('Sec nation ', lpad(s_nationkey, 2, '0'), 'z'), 'Section A') AS name))) AS payload"
    )
    courses = t.nation.selectExpr("to_json(array(struct(n_nationkey AS id, concat('Intro nation-', lpad(n_nationkey, 2, '0'), ' shell') AS name))) AS payload")
    work = t.lineitem.selectExpr(
        "to_json(array(struct(concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id, l_suppkey AS section, if(l_partkey % 2 = 0, concat('Chapter ', l_partkey), null) AS name,"
        f" concat('Chapter ', l_partkey) AS title, if(l_linenumber = 1, null, {ISO_Z.format('l_shipdate + make_dt_interval(0, l_linenumber)')}) AS dueDate, {ISO_Z.format('l_shipdate + make_dt_interval(0, l_linenumber)')} AS endDate))) AS payload"
    )
    wanted = t.nation.where("n_nationkey <= 19").selectExpr("concat('NATION', lpad(n_nationkey, 2, '0')) AS course")
    rows = P.publisher_assignments(sections, courses, work, wanted, TODAY, CAP)
    return rows.withColumn("course", F.expr("concat('NATION', cast(substring(course, 7, 2) AS int))"))


@query(
    "html_embedded_json",
    """SELECT 'C' || (o_custkey % 9) AS course, 'Supersite: ' || (1 + o_orderkey % 5) || ' activities' || CASE WHEN o_orderkey % 2 = 0 THEN ', est 1h 5m' ELSE '' END AS title, strftime(o_orderdate, '%Y-%m-%d') AS date,
'12:55' AS start_time, 'vhl-' || strftime(o_orderdate, '%Y-%m-%d') AS external_id, 'https://x.org/?a=1&b=' || o_orderkey AS url FROM orders WHERE o_orderkey % 6 <> 0""",
)
def html_embedded_json(t):
    payload = (
        "to_json(array(struct(date_format(o_orderdate, 'yyyy-MM-dd') AS due_date, if(o_orderkey % 6 = 0, 0, 1 + o_orderkey % 5) AS assignment_count,"
        " if(o_orderkey % 2 = 0, '1h 5m', null) AS estimated_time, concat('https://x.org/?a=1&b=', o_orderkey) AS detail_url)))"
    )
    escaped = f"replace(replace({payload}, '&', '&amp;'), '\"', '&quot;')"
    pages = t.orders.selectExpr("concat('C', o_custkey % 9) AS course", f"concat('<div id=\"x\" data-assignment-summaries=\"', {escaped}, '\"></div>') AS html")
    return P.embedded_summaries(pages)


@query(
    "toc_flatten",
    """WITH o AS (SELECT o_orderkey AS k, 'C' || (o_custkey % 9) AS course FROM orders)
SELECT course, k || '-1' AS topic_id, 'Top ' || k AS title, '/c/' || k || '/notes_a_.pdf' AS url, 'notes_a_.pdf' AS filename, 'Unit' AS module_path FROM o
UNION ALL SELECT course, k || '-3', 'Deep', '/c/' || k || '/deep.docx', 'deep.docx', 'Unit > Part > Detail' FROM o WHERE k % 2 = 0
UNION ALL SELECT course, k || '-5', 'Low', '/c/' || k || '/low.txt', 'low.txt', array_to_string(['Unit', 'Part'] || list_transform(range(1, 1 + k % 26), lambda i: 'N' || i), ' > ') FROM o""",
)
def toc_flatten(t):
    """Three levels of modules and a chain of up to 25 more; links and topics without a file name give no row."""
    topic = "struct('{t}' AS Title, {u} AS Url, '{k}' AS TypeIdentifier, {i} AS Identifier)"
    top = "struct(concat('Top ', o_orderkey) AS Title, concat('/c/', o_orderkey, '/notes:a?.pdf') AS Url, 'File' AS TypeIdentifier, concat(o_orderkey, '-1') AS Identifier)"
    link = topic.format(t="Doc", u="'https://x.org'", k="Link", i="concat(o_orderkey, '-2')")
    deep = topic.format(t="Deep", u="concat('/c/', o_orderkey, '/deep.docx')", k="File", i="concat(o_orderkey, '-3')")
    none = topic.format(t="None", u="'plain'", k="File", i="concat(o_orderkey, '-4')")
    low = topic.format(t="Low", u="concat('/c/', o_orderkey, '/low.txt')", k="File", i="concat(o_orderkey, '-5')")
    detail = f"to_json(struct('Detail' AS Title, if(o_orderkey % 2 = 0, array({deep}, {none}), array({none})) AS Topics))"
    module = '{"Title":"%s","Topics":%s,"Modules":[%s]}'
    # Text, not structs: the chain of modules is as long as the row says.
    chain = (
        f"aggregate(reverse(sequence(0, cast(o_orderkey % 26 AS int))), '', (a, i) -> printf('{module}', if(i = 0, 'Part', concat('N', i)),"
        f" if(i = o_orderkey % 26, to_json(array({low})), '[]'), concat_ws(',', nullif(a, ''), if(i = 0, {detail}, null))))"
    )
    unit = f"""concat('{{"Modules":[', printf('{module}', 'Unit', to_json(array({top}, {link})), {chain}), ']}}')"""
    raw = t.orders.selectExpr("concat('C', o_custkey % 9) AS course", f"{unit} AS payload")
    return P.content_topics(raw).withColumn("url", F.expr("regexp_replace(url, 'notes:a.\\\\.pdf', 'notes_a_.pdf')"))


@query(
    "news_items",
    """SELECT source AS course, 'oaks-' || doc_id AS id, 'News ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN '2024-01-02' ELSE '2024-01-01' END AS date, trim(text, ' ' || chr(10)) AS text
FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0""",
)
def news_items(t):
    """Hidden and unpublished announcements give no row; whole document texts ride in the payloads."""
    raw = t.documents.selectExpr(
        "source AS course",
        "to_json(array(struct(doc_id AS Id, concat(' News ', doc_id) AS Title, doc_id % 5 <> 0 AS IsPublished, doc_id % 7 = 0 AS IsHidden,"
        " if(doc_id % 2 = 0, '2024-01-02T10:00:00Z', null) AS StartDate, '2024-01-01T00:00:00Z' AS CreatedDate, struct(text AS Text, '' AS Html) AS Body))) AS payload",
    )
    return P.announcements(raw)


@query(
    "grade_items",
    """SELECT 'S' || l_suppkey AS course, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS item_id, 'Item ' || l_partkey AS name, l_quantity AS max_points, l_tax * 100 AS weight, l_returnflag = 'R' AS bonus,
o_orderkey IS NOT NULL AND o_orderstatus = 'F' AS graded, CASE WHEN o_orderstatus = 'F' THEN l_quantity / 2 END AS score, CASE WHEN o_orderstatus = 'F' AND l_linenumber % 2 = 0 THEN 100 ELSE l_quantity END AS out_of
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber NOT IN (5, 7) AND NOT (l_linenumber = 3 AND l_linestatus = 'O')""",
)
def grade_items(t):
    """Objects from lineitem, values from the lines of finished orders; hidden and summing objects drop out."""
    key = "concat_ws('-', l_orderkey, l_linenumber, l_partkey)"
    objects = t.lineitem.selectExpr(
        "concat('S', l_suppkey) AS course",
        f"to_json(array(struct({key} AS Id, concat(' Item ', l_partkey) AS Name, l_quantity AS MaxPoints, l_tax * 100 AS Weight, l_returnflag = 'R' AS IsBonus,"
        " l_linenumber = 3 AND l_linestatus = 'O' AS IsHidden, l_linenumber AS GradeObjectType))) AS payload",
    )
    values = t.lineitem.join(t.orders.where("o_orderstatus = 'F'").select("o_orderkey"), F.expr("l_orderkey = o_orderkey"), "left_semi").selectExpr(
        "concat('S', l_suppkey) AS course",
        f"to_json(array(struct({key} AS GradeObjectIdentifier, l_quantity / 2 AS PointsNumerator, if(l_linenumber % 2 = 0, 100D, null) AS PointsDenominator))) AS payload",
    )
    return P.gradebook(objects, values).select("course", "item_id", "name", "max_points", "weight", "bonus", "graded", "score", "out_of")


@query(
    "quiz_bodies",
    f"""WITH q AS (SELECT doc_id AS k, source AS course, text, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS s FROM documents)
SELECT course, 'oaks-quiz-' || k AS id, 'Quiz ' || k AS name, CASE k % 3 WHEN 0 THEN '2024-01-15 12:30' WHEN 1 THEN '2024-07-15 13:30' ELSE '' END AS due,
CASE k % 4 WHEN 0 THEN 'unlimited attempts' WHEN 1 THEN '1 attempt' WHEN 2 THEN '3 attempts' ELSE '' END AS attempts, CASE WHEN k % 2 = 0 THEN s || chr(10) || chr(10) || 'Be on time.' ELSE s END AS body FROM q""",
)
def quiz_bodies(t):
    raw = t.documents.selectExpr(
        "source AS course",
        "to_json(array(struct(doc_id AS QuizId, concat('Quiz ', doc_id) AS Name, if(doc_id % 3 = 0, '2024-01-15T17:30:00Z', null) AS DueDate, if(doc_id % 3 = 1, '2024-07-15T17:30:00Z', null) AS EndDate,"
        " struct(doc_id % 4 = 0 AS IsUnlimited, CASE doc_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 3 END AS NumberOfAttemptsAllowed) AS AttemptsAllowed,"
        " struct(struct(text AS Text, '' AS Html) AS Text, true AS IsDisplayed) AS Description, struct(if(doc_id % 2 = 0, ' Be on time. ', '') AS Text) AS Footer))) AS payload",
    )
    return P.quiz_bodies(raw)


@query(
    "quiz_notes",
    f"""WITH q AS (SELECT doc_id AS k, source AS course, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS s,
  CASE doc_id % 3 WHEN 0 THEN 'due 2024-01-15 12:30' WHEN 1 THEN 'due 2024-07-15 13:30' END AS due, CASE doc_id % 4 WHEN 0 THEN 'unlimited attempts' WHEN 1 THEN '1 attempt' WHEN 2 THEN '3 attempts' END AS attempts FROM documents)
SELECT k AS id, '# Quiz ' || k || chr(10) || chr(10) || '> Quiz on OAKS for ' || course || CASE WHEN due IS NULL AND attempts IS NULL THEN '' ELSE ' (' || concat_ws(' - ', due, attempts) || ')' END || '.'
  || chr(10) || chr(10) || s || CASE WHEN k % 2 = 0 THEN CASE WHEN s = '' THEN '' ELSE chr(10) || chr(10) END || 'Be on time.' ELSE '' END || chr(10) AS text FROM q WHERE s <> '' OR k % 2 = 0""",
)
def quiz_notes(t):
    """The notes as they are written to disk."""
    return U.quiz_notes(quiz_bodies(t), "OAKS").selectExpr("cast(substring_index(id, '-', -1) AS bigint) AS id", "text")


@query(
    "jsonl_tolerant",
    """SELECT event_id AS line_no, 'C' || (user_id % 12) AS course, event_type || '|' || (props->>'$.k') AS key, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_id % 2 = 0 THEN 'T' || event_id ELSE '' END AS title,
CASE WHEN event_id % 3 = 0 THEN false ELSE true END AS done FROM events WHERE event_id % 10 <> 4 AND event_id % 10 <> 9""",
)
def jsonl_tolerant(t):
    """Lines of a completion log; some are torn in half, some lack their key."""
    line = (
        "to_json(struct(concat('c', user_id % 12) AS course, if(event_id % 10 = 9, null, concat(event_type, '|', get_json_object(props, '$.k'))) AS key,"
        " date_format(ts, \"yyyy-MM-dd'T'HH:mm\") AS date, if(event_id % 2 = 0, concat('T', event_id), null) AS title, if(event_id % 3 = 0, false, null) AS done))"
    )
    lines = t.events.selectExpr("event_id AS line_no", f"{line} AS whole").selectExpr(
        "line_no", "if(line_no % 10 = 4, left(whole, cast(length(whole) / 2 AS int)), whole) AS text"
    )
    return P.completion_log(lines).drop("at")
