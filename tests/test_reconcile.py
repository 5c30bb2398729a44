"""Reconciliation cases, hot keys and application of moves."""

from ledgerloom.operators import reconcile as R

PULLED = "pos long, course string, title string, date date, start_time string, end_time string, all_day boolean, site string, known_times array<string>"
STORED = "id long, course string, title string, date date, start_time string, end_time string, all_day boolean, source string"


def day(text):
    from datetime import date

    return date.fromisoformat(text) if text else None


def run(spark, pulled, stored, today="2026-08-01"):
    p = spark.createDataFrame([(i, c, t, day(d), s, "", False, site, known) for i, (c, t, d, s, site, known) in enumerate(pulled)], PULLED)
    e = spark.createDataFrame([(i, c, t, day(d), s, "", False, src) for i, (c, t, d, s, src) in enumerate(stored)], STORED)
    return sorted((r.kind, r.title, str(r.date), str(r.old_date), tuple(r.old_times), r.n) for r in R.reconcile(p, e, today).collect())


def item(title, date, start="12:00", course="FINC313", site="lms", known=()):
    return (course, title, date, start, site, list(known))


def held(title, date, start="12:00", source="csv", course="FINC313"):
    return (course, title, date, start, source)


def kinds(rows):
    return [(r[0], r[3], r[5]) for r in rows]


def test_cases(spark):
    q = "Quiz 1"
    cases = [
        ([item("Other 9", "2026-09-08")], [held(q, "2026-09-08")], [("new", "None", 1)]),
        ([item(q, "2026-09-08")], [held(q, "2026-09-08")], [("present", "None", 1)]),
        ([item(q, "2026-09-10")], [held(q, "2026-09-08")], [("moved", "2026-09-08", 1)]),
        ([item(q, "2026-09-10")], [held(q, "2026-09-08"), held(q, "2026-09-15")], [("new", "None", 1)]),
        ([item(q, None)], [held(q, "2026-09-08")], []),
        ([item(q, "2026-09-08", "10:00")], [held(q, "2026-09-08")], [("moved", "2026-09-08", 1)]),
        ([item(q, "2026-09-08", "10:00", known=["12:00"])], [held(q, "2026-09-08")], [("present", "None", 1)]),
        ([item(q, "2026-09-08", "10:00")], [held(q, "2026-09-08", source="ics")], [("present", "None", 1)]),
        ([item(q, "2026-07-08", "10:00")], [held(q, "2026-07-08")], [("present", "None", 1)]),
        ([item("FINC 313 Lecture", "2026-09-08")], [held("FINC 313 class", "2026-09-08")], [("new", "None", 1)]),
        ([item("Chapter 2 Assignment", "2026-09-08")], [held("Connect: Chapter 2", "2026-09-08")], [("present", "None", 1)]),
        ([item("Chapter 2 Assignment", "2026-09-08", "10:00")], [held("Connect: Chapter 2", "2026-09-08")], [("moved", "2026-09-08", 1)]),
        ([item("Supersite: 4 activities", "2026-09-08", site="vhl")], [held("VHL Supersite homework", "2026-09-08")], [("present", "None", 1)]),
        ([item(q, "2026-09-08"), item(q, "2026-09-10")], [held(q, "2026-09-08")], [("new", "None", 1), ("present", "None", 1)]),
        ([item(q, "2026-09-10"), item(q, "2026-09-12")], [held(q, "2026-09-08")], [("moved", "2026-09-08", 1), ("new", "None", 1)]),
        ([item(q, "2026-09-10"), item(q, "2026-09-10")], [held(q, "2026-09-08")], [("moved", "2026-09-08", 1), ("new", "None", 1)]),
        ([item(q, "2026-09-08", "10:00")] * 3, [held(q, "2026-09-08")], [("moved", "2026-09-08", 1), ("present", "None", 2)]),
        ([item("Other 9", "2026-09-08")] * 3, [held(q, "2026-09-08")], [("new", "None", 1)]),
    ]
    for pulled, stored, want in cases:
        assert kinds(run(spark, pulled, stored)) == want, (pulled, stored)


def test_hot_key_is_one_row_per_slot(spark):
    """A third of all items share one title; counts stay whole."""
    pulled = [item("Daily homework 5", "2026-09-08") for _ in range(400)] + [item(f"Quiz {i}", "2026-09-09") for i in range(800)]
    stored = [held("Daily homework 5", "2026-09-08")] + [held(f"Quiz {i}", "2026-09-09") for i in range(0, 800, 2)]
    rows = run(spark, pulled, stored)
    assert sum(r[5] for r in rows if r[0] == "present") == 800
    assert sum(1 for r in rows if r[0] == "new") == 400


def moves(spark, rows):
    cols = "pos long, course string, title string, date date, start_time string, end_time string, all_day boolean, old_date date, old_times array<string>"
    return spark.createDataFrame([(p, "FINC313", t, day(d), s, "", False, day(o), ts) for p, t, d, s, o, ts in rows], cols)


def test_apply_moves(spark):
    stored = spark.createDataFrame(
        [
            (1, "FINC313", "Quiz 1", day("2026-09-08"), "9:00", "9:50", False, "csv"),
            (2, "FINC313", "Quiz 2", day("2026-09-08"), "12:00", "13:00", False, "csv"),
            (3, "FINC313", "Connect: Chapter 4", day("2026-09-09"), "12:00", "", False, "csv"),
            (4, "FINC313", "Twin 7", day("2026-09-10"), "12:00", "", False, "csv"),
            (5, "FINC313", "Twin 7", day("2026-09-10"), "12:00", "", False, "csv"),
        ],
        STORED,
    )
    changes = moves(
        spark,
        [
            (10, "Quiz 1", "2026-09-08", "10:00", "2026-09-08", ["09:00"]),
            (11, "Quiz 2", "2026-09-11", "11:00", "2026-09-08", ["12:00"]),
            (12, "Chapter 4 Assignment", "2026-09-12", "12:00", "2026-09-09", ["12:00"]),
            (13, "Twin 7", "2026-09-13", "12:00", "2026-09-10", ["12:00"]),
            (14, "Nowhere 8", "2026-09-14", "12:00", "2026-09-01", []),
            (15, "Gone 9", "2026-09-08", "12:00", "2026-09-08", ["07:00"]),
        ],
    )
    rows, actions = R.apply_moves(stored, changes)
    got = {r.id: (str(r.date), r.start_time, r.end_time) for r in rows.where("rewritten").collect()}
    assert got == {1: ("2026-09-08", "10:00", ""), 2: ("2026-09-11", "11:00", "13:00"), 3: ("2026-09-12", "12:00", "")}
    assert {r.pos: r.action for r in actions.collect()} == {10: "rewritten", 11: "rewritten", 12: "rewritten", 13: "ambiguous", 14: "append", 15: "left"}


def test_untick_stops_looser_matches(spark):
    state = spark.createDataFrame(
        [("FINC313", "FINC313|chapter assignment|2", day("2026-09-08"), "Chapter 2 Assignment", True), ("FINC313", "FINC313|connect chapter|2", day("2026-09-08"), "Connect: Chapter 2", False),
         ("SPAN200", "SPAN200|supersite activities|4", day("2026-09-08"), "Supersite: 4 activities", True)],
        "up string, key string, date date, title string, done boolean",
    )
    events = spark.createDataFrame(
        [(1, "FINC313", "Connect: Chapter 2", day("2026-09-08")), (2, "FINC313", "Ch 2 chapter work", day("2026-09-08")), (3, "SPAN200", "VHL Supersite homework", day("2026-09-08")), (4, "SPAN200", "VHL Supersite homework", day("2026-09-09"))],
        "id long, course string, title string, date date",
    )
    assert {r.id: r.done for r in R.is_done(events, state).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_title_parts_are_carried_and_kept_up(spark):
    """A calendar that carries what titles are compared by is judged the same, is not written again and signs only new rows."""
    stored = spark.createDataFrame([(i, "FINC313", f"Quiz {i}", day("2026-09-08"), "12:00", "", False, "csv") for i in range(1, 5)], STORED)
    rows = [("Quiz 1", "2026-09-08", "12:00"), ("Quiz 2", "2026-09-10", "12:00"), ("Ch Quiz 3", "2026-09-08", "10:00"), ("Essay 9", "2026-09-12", "09:00")]
    pulled = spark.createDataFrame([(i, "FINC313", t, day(d), s, "", False, "lms", []) for i, (t, d, s) in enumerate(rows)], PULLED)
    signed = R.signed(stored)
    assert set(R.signed_once(signed, "id").columns) == {"id", *R.SIGNED}
    plain, carried = (R.reconcile(pulled, t, "2026-08-01") for t in (stored, signed))
    assert sorted(map(str, plain.collect())) == sorted(map(str, carried.collect()))
    changes = carried.where("kind <> 'present'")
    after, _ = R.apply_changes(signed, changes, "-1 - pos")
    bare, _ = R.apply_changes(stored, changes, "-1 - pos")
    assert sorted(map(str, after.select(*stored.columns).collect())) == sorted(map(str, bare.collect()))
    assert after.columns == signed.columns
    again = R.signed(after.select(*stored.columns)).select(*signed.columns)
    assert sorted(map(str, after.collect())) == sorted(map(str, again.collect()))
