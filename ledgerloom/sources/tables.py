"""Views of the test tables in the shapes the operators take.

Each view maps a whole table row by row; none drops or samples rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wall clock and term used by every registered query.
NOW = "2024-01-15 09:30:00"
TERM_START = "2024-01-08"
TERM_END = "2024-05-03"

# Title vocabulary of the ``titles`` view.
VOCABULARY = [
    "Chapter Quiz", "Final Exam Review Session", "Week 3 - Reading", "Midterm Exam", "Research Paper",
    "Problem Set", "Lab Report", "Syllabus Quiz", "Lecture Notes", "Office Hours", "Prueba de vocabulario",
    "Examen final", "Talk Abroad", "Group Presentation", "Connect: Chapter", "Supersite homework",
    "Class Discussion & Debate", "Excel Project", "Orientation", "Guía de estudio", "Essay Draft",
    "Dropbox Submission", "Study Guide for Exam", "Reading on Zoom",
]


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def deadlines(events: DataFrame) -> DataFrame:
    """events -> calendar rows (id, course, title, starts_at, ends_at, all_day, kind, source)."""
    base = events.selectExpr(
        "event_id AS id",
        "concat('C', user_id % 12) AS course",
        "cast(get_json_object(props, '$.k') AS int) AS k",
        "event_type",
        "event_id % 10 = 0 AS all_day",
        "if(event_id % 10 = 0, cast(cast(ts AS date) AS timestamp_ntz),"
        " ts - make_dt_interval(0, 0, 0, extract(SECOND FROM ts))) AS starts_at",
    )
    return base.selectExpr(
        "id",
        "course",
        "concat(CASE event_type WHEN 'purchase' THEN 'Exam' WHEN 'signup' THEN 'Project'"
        " WHEN 'click' THEN if(k % 3 = 0, 'Reading', 'Quiz') WHEN 'view' THEN 'Class' ELSE 'Signup' END, ' ', k % 20,"
        " CASE WHEN k % 7 = 0 THEN ', est 1h 10m' WHEN k % 11 = 0 THEN ' (25m)' ELSE '' END) AS title",
        "starts_at",
        "if(id % 3 = 0, starts_at + make_dt_interval(0, k % 50), null) AS ends_at",
        "all_day",
        "CASE event_type WHEN 'purchase' THEN 'exam' WHEN 'signup' THEN 'project' WHEN 'click' THEN 'quiz'"
        " WHEN 'view' THEN 'recurring' ELSE 'admin' END AS kind",
        "CASE id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'ics' ELSE 'recurring' END AS source",
    )


def titles(part: DataFrame) -> DataFrame:
    """part -> (id, course, title): numbered titles, some with bracketed asides or estimates."""
    return part.selectExpr(
        "p_partkey AS id",
        "concat('FINC', 300 + p_partkey % 7) AS course",
        f"concat(element_at(array({sql_list(VOCABULARY)}), cast(p_partkey % {len(VOCABULARY)} AS int) + 1), ' ', p_size,"
        " CASE p_partkey % 5 WHEN 0 THEN ' [self-paced target]' WHEN 1 THEN ', est 1h 10m'"
        " WHEN 2 THEN ' (25m)' ELSE '' END) AS title",
    )


def grade_items(lineitem: DataFrame) -> DataFrame:
    """lineitem -> gradebook items, one course per supplier."""
    return lineitem.selectExpr(
        "concat('S', l_suppkey) AS course",
        "concat('Item ', l_partkey, '-', l_orderkey, '-', l_linenumber) AS name",
        "l_orderkey AS pos",
        "cast(l_quantity AS decimal(12,2)) AS max_points",
        "cast(l_quantity AS decimal(12,2)) AS out_of",
        "cast(round(l_quantity * (1 - l_discount), 2) AS decimal(12,2)) AS score",
        "l_linestatus = 'F' AS graded",
        "l_returnflag = 'R' AND l_linenumber = 1 AS bonus",
        "l_linenumber = 7 AS excluded",
        "cast(round(l_tax * 100, 2) AS decimal(12,2)) AS weight",
        "if(l_orderkey % 2 = 0, null, cast(round(l_quantity * (1 - l_discount), 2) AS decimal(12,2))) AS weighted_num",
        "if(l_orderkey % 2 = 0, null, cast(l_quantity AS decimal(12,2))) AS weighted_den",
    )


def corpus_files(documents: DataFrame) -> DataFrame:
    """documents -> files of a library (collection, path, mtime, size)."""
    return documents.selectExpr(
        "doc_id",
        "source AS collection",
        "concat(source, '/', doc_id, CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.TXT' WHEN 'de' THEN '.html'"
        " ELSE '' END) AS path",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(doc_id AS decimal(18,6))) AS mtime",
        "n_chars AS size",
        "text",
    )


def vectors(embeddings: DataFrame) -> DataFrame:
    """embeddings -> one vector per chunk, one collection per label."""
    return embeddings.selectExpr("vec_id AS chunk_id", "concat('L', label) AS collection", "embedding")


def probes(embeddings: DataFrame) -> DataFrame:
    """One question vector per collection: the mean of its vectors, scaled to unit length."""
    mean = (
        embeddings.select("label", F.posexplode("embedding").alias("dim", "x"))
        .groupBy("label", "dim")
        .agg(F.expr("avg(cast(x AS double)) AS x"))
        .groupBy("label")
        .agg(F.expr("transform(array_sort(collect_list(struct(dim, x))), p -> p.x) AS v"))
    )
    return mean.selectExpr(
        "cast(label AS bigint) AS question_id",
        "transform(v, x -> x / greatest(sqrt(aggregate(v, 0D, (s, y) -> s + y * y)), 1e-12D)) AS qvec",
    )


def messages(conversations: DataFrame) -> DataFrame:
    """conversations -> chat messages in turn order."""
    return conversations.selectExpr("conv_id AS conversation_id", "turn", "role", "text AS content")


# Day specs and clock strings of the ``venues`` view.
DAY_SPECS = ["Tue-Fri", "Mon, Wed, Fri", "daily", "Fri-Sun", "Sun-Thu", "unknown", "Mon, Thu (call ahead)",
             "Sat & Sun", "Wednesday and Thursday", "Mon-Tue, Thu"]
CLOCKS = ["16:00", "4pm", "5:30 PM", "", "late", "11am", "17:15"]


def pick(values, key: str) -> str:
    return f"element_at(array({sql_list(values)}), cast({key} % {len(values)} AS int) + 1)"


def venues(supplier: DataFrame) -> DataFrame:
    """supplier -> venues with free-text days and clock times."""
    return supplier.selectExpr(
        "s_suppkey AS id",
        "s_name AS name",
        f"{pick(DAY_SPECS, 's_suppkey')} AS days_spec",
        f"{pick(CLOCKS, 's_suppkey')} AS start_text",
        f"{pick(CLOCKS, '(s_suppkey + 2 + s_nationkey)')} AS end_text",
    )


# Wording of gradebook items and of the calendar rows that may name them.
ITEM_NAMES = ["Chapter Quiz", "Midterm Exam", "Research Paper", "Lab Report", "Excel Project"]
EVENT_NAMES = ["Ch Quiz", "Midterm Exam (in class)", "Paper due", "Lab Report draft", "Proyecto de Excel", "Chapter Quiz at 10:30 am"]


def books(lineitem: DataFrame) -> DataFrame:
    """lineitem -> one small gradebook per order; two thirds of the books carry weights that add up to 100."""
    live = lineitem.groupBy("l_orderkey").agg(
        F.expr("count_if(NOT (l_linenumber = 7 OR (l_returnflag = 'R' AND l_linenumber = 1))) AS live")
    )
    return lineitem.join(live, "l_orderkey").selectExpr(
        "concat('BK', l_orderkey) AS course",
        f"concat({pick(ITEM_NAMES, 'l_partkey')}, ' ', l_linenumber) AS name",
        "cast(l_quantity AS decimal(12,2)) AS max_points",
        "cast(l_quantity AS decimal(12,2)) AS out_of",
        "cast(round(l_quantity * (1 - l_discount), 2) AS decimal(12,2)) AS score",
        "l_linestatus = 'F' AS graded",
        "l_returnflag = 'R' AND l_linenumber = 1 AS bonus",
        "l_linenumber = 7 AS excluded",
        "cast(if(l_orderkey % 3 = 0, l_tax * 100, round(100D / greatest(live, 1), 2)) AS decimal(12,2)) AS weight",
        "cast(round(l_quantity * (1 - l_discount), 2) AS decimal(12,2)) AS weighted_num",
        "cast(l_quantity AS decimal(12,2)) AS weighted_den",
    )


def book_events(lineitem: DataFrame) -> DataFrame:
    """lineitem -> one calendar row per line, worded independently of the gradebook."""
    return lineitem.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id",
        "concat('BK', l_orderkey) AS course",
        f"concat({pick(EVENT_NAMES, '(l_partkey + l_suppkey % 2)')}, ' ', l_linenumber) AS title",
        "cast(l_shipdate AS date) AS date",
    )


# Wording of stored and pulled work.
WORK_NAMES = ["Chapter Quiz", "Problem Set", "Reading Response", "Lab Report", "Case Study Memo"]
TODAY = "1998-01-01"


def _work(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS k",
        "concat('FINC', 300 + (o_orderkey div 10) % 40) AS course",
        f"CASE WHEN o_orderkey % 17 = 0 THEN concat('VHL Supersite homework ', o_orderkey) WHEN o_orderkey % 10 >= 7"
        f" THEN concat({pick(WORK_NAMES, '(o_orderkey div 10)')}, ' series ', o_orderkey div 10)"
        f" ELSE concat({pick(WORK_NAMES, '(o_orderkey div 10)')}, ' ', o_orderkey) END AS title",
        "cast(o_orderdate AS date) AS date",
        "cast(8 + o_orderkey % 10 AS int) AS hour",
    )


def stored_work(orders: DataFrame) -> DataFrame:
    """orders -> calendar rows already held (id, course, title, date, start_time, end_time, all_day, source)."""
    return _work(orders).selectExpr(
        "k AS id", "course", "title", "date", "concat(lpad(hour, 2, '0'), ':00') AS start_time",
        "if(k % 3 = 0, concat(hour + 2, ':30'), '') AS end_time", "false AS all_day",
        "CASE WHEN k % 5 = 0 THEN 'ics' ELSE 'csv' END AS source",
    )


def pulled_work(orders: DataFrame) -> DataFrame:
    """orders -> items as a site serves them: some reworded, new, moved, retimed, undated or served twice."""
    return _work(orders).selectExpr("*", "explode(sequence(0, if(k % 23 = 0, 1, 0))) AS copy").selectExpr(
        "k * 2 + copy AS pos",
        "course",
        "CASE WHEN k % 17 = 0 THEN concat('Supersite: ', 1 + k % 9, ' activities') WHEN k % 11 = 0 THEN concat('Brand new task ', k + 1000000)"
        " WHEN k % 13 = 0 THEN concat('Updated online version: ', title) ELSE concat(title, ' [synced]') END AS title",
        "CASE WHEN k % 19 = 0 THEN null WHEN k % 7 = 0 THEN date_add(date, 3) ELSE date END AS date",
        "concat(lpad(if(k % 4 = 0, hour + 1, hour), 2, '0'), ':00') AS start_time",
        "if(k % 29 = 0, '21:45', '') AS end_time",
        "false AS all_day",
        "if(k % 17 = 0, 'vhl', 'lms') AS site",
        "if(k % 8 = 0, array(concat(lpad(hour, 2, '0'), ':00'), '23:59'), cast(array() AS array<string>)) AS known_times",
    )
