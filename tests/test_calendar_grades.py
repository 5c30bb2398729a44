"""Calendar sources, workload rules, gradebook and venue functions on small fixtures."""

import random
from datetime import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import venues as V
from ledgerloom.operators import grading as G
from ledgerloom.operators import timeline as L
from ledgerloom.operators import upkeep as U
from ledgerloom.operators import workload as W
from ledgerloom.session import shared_dir
from ledgerloom.sources import calendars as C

EVENT = "id long, course string, title string, starts_at timestamp_ntz, ends_at timestamp_ntz, all_day boolean, kind string, source string"


def value(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return row.select(F.expr(expression).alias("x")).first().x


@pytest.mark.parametrize(
    "spec, days",
    [("Tue-Fri", [1, 2, 3, 4]), ("Fri-Sun", [4, 5, 6]), ("Sun-Thu", [0, 1, 2, 3, 6]), ("unknown", []), ("whenever", []), ("Mon, Thu (call ahead)", []),
     ("Daily", [0, 1, 2, 3, 4, 5, 6]), ("Mon & Wed", [0, 2]), ("sat–sun", [5, 6]), ("", []), ("Mon-Funday", [])],
)
def test_parse_days(spark, spec, days):
    assert value(spark, V.parse_days("s"), s=spec) == days


@pytest.mark.parametrize("text, minute", [("16:00", 960), ("4pm", 960), ("12am", 0), ("12:30 PM", 750), ("24:00", None), ("13pm", None), ("9", None), ("late", None)])
def test_clock(spark, text, minute):
    assert value(spark, V.clock_minute("s"), s=text) == minute


@pytest.mark.parametrize("pct, letter", [(93, "A"), (92.9, "A-"), (61, "D-"), (60.9, "F"), (None, None)])
def test_letters(spark, pct, letter):
    assert spark.range(1).select(F.expr(G.letter("null" if pct is None else f"{pct}D"))).first()[0] == letter


def books(spark, rows):
    names = "name max_points out_of score graded bonus excluded weight weighted_num weighted_den".split()
    cols = "course string, name string, max_points decimal(12,2), out_of decimal(12,2), score decimal(12,2), graded boolean, bonus boolean, excluded boolean, weight decimal(12,2), weighted_num decimal(12,2), weighted_den decimal(12,2)"
    base = dict(name="i", max_points=10, out_of=10, score=None, graded=False, bonus=False, excluded=False, weight=0, weighted_num=None, weighted_den=None)
    num = lambda v: Decimal(str(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return spark.createDataFrame([(r.pop("course", "C"), *[num({**base, **r}[n]) for n in names]) for r in rows], cols)


def test_grade_summary(spark):
    one = lambda *rows: G.grade_summary(books(spark, list(rows))).first()
    r = one(dict(score=8, graded=True), dict(score=2, out_of=2, graded=True, bonus=True))
    assert (r.points_earned, r.points_possible, r.current_pct, r.basis) == (10, 10, 100.0, "points")
    r = one(dict(score=1, graded=True, weighted_num=16, weighted_den=20), dict(score=1, graded=True, weighted_num=30))
    assert (r.current_pct, r.basis) == (80.0, "weighted")
    r = one(dict(score=9.75, graded=True, weighted_num=9.75, weighted_den=10), dict())
    assert (r.current_pct, r.graded_count, r.total_count) == (97.5, 1, 2)
    assert one(dict()).basis == "nothing graded yet"


def test_strict_matching(spark):
    items = books(spark, [dict(course="FINC313", name=n, weight=w, graded=True, score=1, weighted_num=1, weighted_den=1) for n, w in [("Chapters 11", 50), ("Final Exam", 25), ("Excel Project 1", 12.5), ("Excel Project 2", 12.5)]])
    titles = ["Ch 11", "FINC 313 Final Exam", "Excel Project", "Excel Project 2 (draft)", "Project 12"]
    events = spark.createDataFrame([(str(i), "FINC313", t, dt(2026, 9, 8 + i).date()) for i, t in enumerate(titles)], "id string, course string, title string, date date")
    pairs = {(r.name, r.title) for r in G.strict_pairs(items, events).collect()}
    assert pairs == {("Chapters 11", "Ch 11"), ("Excel Project 2", "Excel Project 2 (draft)")} | ({("Final Exam", "FINC 313 Final Exam")})
    assert {r.title: r.stake for r in G.stake_match(items, events).collect()} == {"Ch 11": 50.0, "FINC 313 Final Exam": 25.0, "Excel Project 2 (draft)": 12.5}


def test_two_cutoffs(spark):
    """An all-day row of today is still upcoming but no longer ahead."""
    events = spark.createDataFrame([(1, "A", "Paper", dt(2026, 9, 8), None, True, "project", "csv"), (2, "A", "Quiz", dt(2026, 9, 8, 8), None, False, "quiz", "csv")], EVENT)
    now = "2026-09-08 09:00:00"
    assert [r.id for r in W.next_events(events, now).collect()] == [1]
    assert W.ahead(events, now).count() == 0
    rules = spark.createDataFrame([("QUIET",)], "course string")
    rows = {r.course: (r.total, r.remaining, r.note) for r in W.by_course(events, rules, now).collect()}
    assert rows == {"A": (2, 0, "all deadlines passed"), "QUIET": (0, 0, "no dated work published")}


def test_week_views_agree(spark):
    rows = [(i, f"C{i % 3}", "t", dt(2026, 9, 1 + i % 28, i % 24), None, False, ["exam", "quiz", "recurring", "admin"][i % 4], "csv") for i in range(200)]
    events = spark.createDataFrame(rows, EVENT)
    a = {r.week_start: r["count"] for r in W.week_load(events, "2026-09-07", "2026-12-01").collect()}
    split = W.week_load_by_course(events, "2026-09-07", "2026-12-01")
    b = {r.week_start: r.n for r in split.groupBy("week_start").agg(F.sum("n").alias("n")).collect()}
    assert a == b and sum(a.values()) == 150 and len(a) == 14


def test_stretches_equal_sessions(spark):
    days = [1, 2, 9, 17, 18, 40]
    rows = spark.createDataFrame([("k", "c", dt(2026, 1, 1).date())], "k string, course string, date date").select(
        "k", "course", F.explode(F.array(*[F.expr(f"date_add(date, {d})") for d in days])).alias("date")
    )
    a = {(r.start, r.end) for r in L.stretches(rows, ["k"]).collect()}
    b = {(r.start, r.end) for r in L.stretches_by_session(rows, ["k"]).collect()}
    assert a == b and len(a) == 3
    assert sorted(r.days for r in L.clear_runs(rows, "2025-12-20", ["k"]).collect()) == [7, 12, 21]


def test_csv_fixture(spark):
    lines = ["course,title,date,start_time,end_time,all_day,kind", "T1,Quiz 1,2026-09-08,12:00,,false,quiz", 'T1,"Big, Exam",2026-09-21,09:00,10:30,false,exam',
             "T1,Reading day,2026-09-22,,,true,admin", "T1,Bad kind,2026-09-23,12:00,,false,homework", "T1,Bad date,not-a-date,12:00,,false,quiz"]
    lines[4:4] = ["", '"T1","Two\n""lines""",2026-09-22,,,true,exam', ""]
    df = spark.createDataFrame([("f", "\r\n".join(lines)), ("g", "course,title\r\nT1,x"), ("h", ""), ("i", None)], "file string, text string")
    rows = C.deadline_csv(df).where("file = 'f'").orderBy("line_no").collect()
    assert [r.error is None for r in rows] == [True, True, True, True, False, False] and rows[3].title == 'Two\n"lines"'
    refused = C.deadline_csv(df).where("file <> 'f'").collect()
    assert sorted(r.file for r in refused) == ["g", "h", "i"] and all(r.error.startswith("header") for r in refused)
    assert rows[1].title == "Big, Exam" and rows[1].ends_at == dt(2026, 9, 21, 10, 30) and rows[2].starts_at == dt(2026, 9, 22)


def test_recurring_fixture(spark):
    rules = spark.createDataFrame([(1, "T", "Class", [0, 2, 4], "09:00", "09:50")], "rule_id int, course string, title string, weekdays array<int>, start_time string, end_time string")
    breaks = spark.createDataFrame([(dt(2026, 9, 14).date(), dt(2026, 9, 16).date())], "start date, end date")
    got = sorted(r.starts_at.day for r in U.expand_recurring(rules, breaks, "2026-09-07", "2026-09-25").collect())
    assert got == [7, 9, 11, 18, 21, 23, 25]


def test_ics_weekly_rule_with_exception(spark):
    body = ("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Lab\r\nDTSTART:20260901T100000\r\nDTEND:20260901T110000\r\nRRULE:FREQ=WEEKLY;COUNT=4\r\nEXDATE:20260908T100000\r\nEND:VEVENT\r\n"
            "BEGIN:VEVENT\r\nSUMMARY:Fair\r\nDTSTART;VALUE=DATE:20260910\r\nDTEND;VALUE=DATE:20260911\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    events = C.ics_events(spark.createDataFrame([("f", body)], "feed string, body string"))
    rows = C.expand_rules(events, "2026-09-02", "2026-12-31").orderBy("starts_at").collect()
    assert [(r.title, r.starts_at.day, r.ends_at.day, r.all_day) for r in rows] == [("Fair", 10, 10, True), ("Lab", 15, 15, False), ("Lab", 22, 22, False)]


def test_import_is_idempotent_and_keeps_broken_sources(spark):
    cols = "pos long, id long, title string, source string, error string"
    parsed = spark.createDataFrame([(1, 1, "a", "csv", None), (2, 1, "b", "csv", None), (3, 2, "c", "ics", None), (4, 3, "d", "ics", "bad")], cols)
    existing = spark.createDataFrame([(9, "old", "csv"), (8, "old", "ics"), (2, "older", "ics")], "id long, title string, source string")
    once = U.rebuild_or_upsert(existing, parsed)
    want = {(1, "b", "csv"), (2, "c", "ics"), (8, "old", "ics")}
    assert {tuple(r) for r in once.select("id", "title", "source").collect()} == want
    saved = U.save_sources(once, shared_dir(spark, "events"))
    assert {tuple(r) for r in saved.select("id", "title", "source").collect()} == want
    assert {tuple(r) for r in U.rebuild_or_upsert(saved, parsed).select("id", "title", "source").collect()} == want


def test_match_course_prefers_longest_code(spark):
    texts = spark.createDataFrame([(1, "Intro to finc-313 honors"), (2, "FINC 31"), (3, "music")], "id long, text string")
    codes = spark.createDataFrame([("FINC31",), ("FINC313",)], "code string")
    assert {r.id: r.course for r in U.match_course(texts, codes).collect()} == {1: "FINC313", 2: "FINC31", 3: "OTHER"}


def test_match_course_among_many_codes(spark):
    """100,000 codes in one automaton and in several give what a plain search gives."""
    codes = spark.range(100_000).selectExpr("concat('Code ', id, if(id % 3 = 0, '-x', '')) AS code").unionByName(spark.createDataFrame([(None,), ("co de 7",), ("CODE 7",)], "code string"))
    texts = spark.createDataFrame([(1, "see code_99999-X and code 12"), (2, "code"), (3, None), (4, ""), (5, "xcode 7!"), (5, "code 3 x"), (6, "Code 123456")], "id long, text string")
    want = [(1, "Code 99999-x"), (2, "OTHER"), (3, "OTHER"), (4, "OTHER"), (5, "CODE 7"), (5, "Code 3-x"), (6, "Code 1234")]
    for limit in (U.AUTOMATON_BYTES, 700_000):
        assert sorted((r.id, r.course) for r in U.match_course(texts, codes, limit).collect()) == sorted(want)
    blank = codes.unionByName(spark.createDataFrame([(" - ",)], "code string"))
    assert sorted((r.id, r.course) for r in U.match_course(texts, blank).collect())[1:4] == [(2, " - "), (3, "OTHER"), (4, " - ")]
    assert U.match_course(texts, codes.limit(0)).where("course <> 'OTHER'").count() == 0


def test_match_course_makes_no_row_per_substring(spark):
    plan = U.match_course(spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([("a",)], "code string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Exchange" not in text and "Generate" not in text


def test_strict_pairs_are_all_pairs_by_few_shuffles(spark):
    """Every pair that a comparison of all with all finds; behind the written leads, two sides of one join and a distinct."""
    rng = random.Random(5)
    pool = ["chapter", "ch", "quiz", "chart", "quick", "exam", "essay", "draft", "lab"]
    make = lambda n: [(f"BK{rng.randrange(3)}", " ".join([*rng.sample(pool, rng.randint(1, 3)), *map(str, range(1, rng.randint(1, 3)))])) for _ in range(n)]
    names, titles = make(60), make(80)
    found = G.strict_pairs(spark.createDataFrame(names, "course string, name string"), spark.createDataFrame(titles, "course string, title string"))
    meet = lambda x, y: x == y or len(x) >= 2 and y.startswith(x) or len(y) >= 2 and x.startswith(y)
    covers = lambda a, b: all(any(meet(x, y) for y in b) for x in a)

    def same(course, a, b):
        nums = [{w for w in t.split() if w.isdigit() and w != course[2:]} for t in (a, b)]
        a, b = ([w for w in t.split()] for t in (a, b))
        return nums[0] == nums[1] and (covers(a, b) or covers(b, a))

    want = {(c, n, t) for c, n in names for d, t in titles if c == d and same(c, n, t)}
    assert {tuple(r) for r in found.collect()} == want and want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
