"""Workload analytics over calendar rows (id, course, title, starts_at, ends_at, all_day, kind, source).

Two cut-offs exist and both are kept. ``due_cutoff`` lets an all-day row stay upcoming until 23:59:59;
the per-course, per-kind and per-day counts compare the stored start instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.patterns import ESTIMATE, literal
from ledgerloom.functions.titles import looks_graded

DEADLINE_KINDS = ("exam", "project", "quiz")
DUE_CUTOFF = "if(all_day, cast(cast(starts_at AS date) AS timestamp_ntz) + INTERVAL '86399' SECOND, starts_at)"
DAY = "cast(starts_at AS date)"
WEEK = "date_sub(cast(starts_at AS date), weekday(cast(starts_at AS date)))"


def at(now: str) -> str:
    return f"timestamp_ntz'{now}'"


def day_of(now: str) -> str:
    return f"date'{now[:10]}'"


def monday_of(day: str) -> str:
    return f"date_sub({day}, weekday({day}))"


def upcoming_cutoff(events: DataFrame) -> DataFrame:
    return events.select("id", "starts_at", "all_day", F.expr(DUE_CUTOFF).alias("due_at"))


def events_between(events: DataFrame, start: str, end: str) -> DataFrame:
    """Rows that start in [start, end) or run into it."""
    return events.where(f"starts_at < {at(end)} AND coalesce(ends_at, starts_at) >= {at(start)}")


def upcoming(events: DataFrame, now: str, kinds: Sequence[str] | None = DEADLINE_KINDS) -> DataFrame:
    """Rows not yet past by the end-of-day rule. The first bound is implied and reaches the scan."""
    out = events.where(f"starts_at >= cast({day_of(now)} AS timestamp_ntz)").where(f"{DUE_CUTOFF} >= {at(now)}")
    return out.where(F.col("kind").isin(*kinds)) if kinds else out


def ahead(events: DataFrame, now: str) -> DataFrame:
    """Deadline rows whose stored start has not passed."""
    return events.where(F.col("kind").isin(*DEADLINE_KINDS)).where(f"starts_at >= {at(now)}")


def next_events(events: DataFrame, now: str, limit: int = 8, kinds: Sequence[str] | None = DEADLINE_KINDS) -> DataFrame:
    return upcoming(events, now, kinds).orderBy("starts_at", "id").limit(limit)


def next_up(events: DataFrame, now: str, limit: int = 8) -> DataFrame:
    """The soonest row of each (course, title), then the first ``limit`` of those."""
    first = upcoming(events, now).groupBy("course", "title").agg(
        F.expr("min(struct(starts_at, id, kind, all_day)) AS f")
    )
    return (
        first.select("course", "title", "f.starts_at", "f.id", "f.kind", "f.all_day")
        .orderBy("starts_at", "id")
        .limit(limit)
    )


def due_within(events: DataFrame, now: str, horizons: Sequence[int]) -> DataFrame:
    """How many deadlines fall due within each horizon, in one pass."""
    longest = max(horizons)
    rows = upcoming(events, now).where(f"starts_at < {at(now)} + make_dt_interval({longest})")
    counts = [F.expr(f"count_if(starts_at < {at(now)} + make_dt_interval({d}))").alias(f"d{d}") for d in horizons]
    pairs = ", ".join(f"{d}, d{d}" for d in horizons)
    return rows.agg(*counts).selectExpr(f"stack({len(horizons)}, {pairs}) AS (days, n)")


def by_course(events: DataFrame, scheduled: DataFrame, now: str) -> DataFrame:
    """Deadline counts per course; every scheduled course appears even with nothing dated."""
    is_ahead = f"starts_at >= {at(now)}"
    counted = events.where(F.col("kind").isin(*DEADLINE_KINDS)).groupBy("course").agg(
        F.count("*").alias("total"),
        F.expr(f"count_if({is_ahead}) AS remaining"),
        *[F.expr(f"count_if({is_ahead} AND kind = '{k}')").alias(k) for k in ("exam", "quiz", "project")],
        F.expr(f"min(struct(starts_at, id, title, kind)) FILTER (WHERE {is_ahead}) AS nxt"),
    )
    joined = scheduled.select("course").distinct().join(counted, "course", "full_outer")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "remaining", "exam", "quiz", "project")]
    return joined.select(
        "course",
        *zero,
        F.col("nxt.title").alias("next_title"),
        F.col("nxt.starts_at").alias("next_at"),
        F.col("nxt.kind").alias("next_kind"),
        F.expr(f"datediff(cast(nxt.starts_at AS date), {day_of(now)}) AS days_until_next"),
        F.expr(
            "CASE WHEN coalesce(total, 0) = 0 THEN 'no dated work published'"
            " WHEN remaining = 0 THEN 'all deadlines passed' ELSE '' END AS note"
        ),
    )


def by_kind(events: DataFrame, now: str) -> DataFrame:
    """Deadlines ahead per kind, zero where a kind has none."""
    counts = [F.expr(f"count_if(kind = '{k}')").alias(k) for k in DEADLINE_KINDS]
    pairs = ", ".join(f"'{k}', {k}" for k in DEADLINE_KINDS)
    return ahead(events, now).agg(*counts).selectExpr(f"stack({len(DEADLINE_KINDS)}, {pairs}) AS (kind, n)")


def daily_load(events: DataFrame, now: str, days: int = 28) -> DataFrame:
    """Deadlines per day and course of the coming ``days``, with the day's total beside.

    One row per day and course; a day without deadlines is one row with count 0 and no course. Courses stay
    rows, not a map, so a day's row does not grow with the number of courses.
    """
    spine = events.sparkSession.range(days).selectExpr(f"date_add({day_of(now)}, cast(id AS int)) AS date")
    per_course = (
        ahead(events, now)
        .where(f"starts_at < {at(now)} + make_dt_interval({days})")
        .groupBy(F.expr(f"{DAY} AS date"), "course")
        .agg(F.count("*").alias("n"))
    )
    return _on_spine(spine, per_course, "date").select("date", "count", "course", "n")


def _on_spine(spine: DataFrame, counts: DataFrame, day: str) -> DataFrame:
    """Every spine row with its counts and their total, zero where there are none."""
    total = counts.groupBy(day).agg(F.sum("n").alias("count"))
    return (
        spine.join(total, day, "left").join(counts, day, "left")
        .withColumn("count", F.coalesce("count", F.lit(0))).withColumn("n", F.coalesce("n", F.lit(0)))
    )


def week_spine(weeks: DataFrame, term_start: str, term_end: str) -> DataFrame:
    """Every Monday from the earlier of term and data to the later of both."""
    lo, hi = monday_of(f"date'{term_start}'"), monday_of(f"date'{term_end}'")
    return weeks.agg(
        F.expr(f"least({lo}, min(week_start)) AS lo"), F.expr(f"greatest({hi}, max(week_start)) AS hi")
    ).selectExpr("explode(sequence(lo, hi, interval 7 days)) AS week_start")


def _week_counts(events: DataFrame, *keys: str) -> DataFrame:
    return (
        events.where("kind <> 'admin'")
        .groupBy(F.expr(f"{WEEK} AS week_start"), *keys)
        .agg(F.count("*").alias("n"), F.expr("count_if(kind <> 'recurring') AS d"))
    )


def week_load(events: DataFrame, term_start: str, term_end: str) -> DataFrame:
    """Rows and deadlines per Monday week over term and data, zero-filled."""
    counts = _week_counts(events)
    return week_spine(counts, term_start, term_end).join(counts, "week_start", "left").select(
        "week_start", F.expr("coalesce(n, 0) AS count"), F.expr("coalesce(d, 0) AS deadlines")
    )


def week_load_by_course(events: DataFrame, term_start: str, term_end: str) -> DataFrame:
    """``week_load`` split by course on the same spine: one row per week and course with the week's total."""
    counts = _week_counts(events, "course").drop("d")
    return _on_spine(week_spine(counts, term_start, term_end), counts, "week_start").select("week_start", "count", "course", "n")


def worst_week(events: DataFrame, now: str, term_start: str, term_end: str) -> DataFrame:
    """The fullest week from this Monday on; the first one wins a tie."""
    return (
        week_load(events, term_start, term_end)
        .where(f"week_start >= {monday_of(day_of(now))}")
        .orderBy(F.desc("count"), "week_start")
        .limit(1)
    )


def week_index(events: DataFrame, now: str, term_start: str, term_end: str) -> DataFrame:
    """"Week i of N" over the week spine, and which one is now. The spine holds one row per week."""
    weeks = week_load(events, term_start, term_end)
    span = weeks.agg(F.struct(F.min("week_start").alias("first"), F.count("*").alias("weeks")).alias("span"))
    return weeks.select("*", span.scalar().alias("span")).selectExpr(
        "week_start",
        "count",
        "cast(datediff(week_start, span.first) div 7 + 1 AS int) AS week_no",
        "span.weeks",
        f"week_start = {monday_of(day_of(now))} AS is_current",
    )


def busiest_days(events: DataFrame, now: str, limit: int = 5) -> DataFrame:
    """Items of the ``limit`` fullest days ahead, one row per item; single-item days drop out last."""
    rows = ahead(events, now).withColumn("date", F.expr(DAY))
    top = rows.groupBy("date").count().orderBy(F.desc("count"), "date").limit(limit).where("count > 1")
    return rows.join(top, "date").select("date", "count", "id", "course", "title")


def top_repeat(events: DataFrame, now: str) -> DataFrame:
    """The (course, title) that repeats most among quizzes from today on."""
    return (
        events.where("kind = 'quiz'")
        .where(f"starts_at >= cast({day_of(now)} AS timestamp_ntz)")
        .groupBy("course", "title")
        .count()
        .orderBy(F.desc("count"), "course", "title")
        .limit(1)
    )


def plan_items(events: DataFrame, now: str) -> DataFrame:
    """Actionable rows of today and tomorrow with estimate, graded flag and all-day-aware ``past``."""
    today = day_of(now)
    est = f"regexp_extract(title, {literal(ESTIMATE)}, 1)", f"regexp_extract(title, {literal(ESTIMATE)}, 2)"
    return (
        events.where("kind <> 'recurring'")
        .where(f"starts_at >= cast({today} AS timestamp_ntz)")
        .where(f"starts_at < cast(date_add({today}, 2) AS timestamp_ntz)")
        .selectExpr(
            "id",
            "course",
            "title",
            "starts_at",
            "all_day",
            f"if({DAY} = {today}, 'today', 'tomorrow') AS day",
            f"if(all_day, {DAY} < {today}, starts_at < {at(now)}) AS past",
            "kind",
            f"{looks_graded('title', 'kind')} AS graded",
            f"coalesce(nullif({est[0]}, ''), nullif({est[1]}, '')) AS estimated",
        )
    )


def plan_capped(events: DataFrame, now: str, window_days: int = 7, day_cap: int = 6) -> DataFrame:
    """Up to ``day_cap`` rows a day for a week; the next open row is always among them.

    ``hidden`` says how many of the day's rows the cap leaves out.
    """
    today = day_of(now)
    rows = (
        events.where(F.col("kind").isin(*DEADLINE_KINDS))
        .where(f"starts_at >= cast({today} AS timestamp_ntz)")
        .where(f"starts_at < cast(date_add({today}, {window_days}) AS timestamp_ntz)")
        .selectExpr("id", "course", "title", "starts_at", f"{DAY} AS date", f"if(all_day, {DAY} < {today}, starts_at < {at(now)}) AS past")
    )
    nxt = rows.where("NOT past").agg(F.expr("min(struct(starts_at, id)).id AS next_id"))
    sizes = rows.groupBy("date").agg(F.count("*").alias("due"))
    flagged = rows.withColumn("is_next", F.coalesce(F.col("id") == nxt.scalar(), F.lit(False)))
    w = Window.partitionBy("date").orderBy(F.desc("is_next"), "starts_at", "id")
    shown = flagged.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= day_cap)
    return shown.join(sizes, "date").selectExpr(
        "date", "id", "course", "title", "starts_at", "is_next", "due", f"greatest(due - {day_cap}, 0) AS hidden"
    )


def sliding_due(events: DataFrame, days: int = 7) -> DataFrame:
    """For each day, how many deadlines fall in the ``days`` days starting with it."""
    return (
        events.where(F.col("kind").isin(*DEADLINE_KINDS))
        .groupBy(F.expr(f"{DAY} AS day"))
        .count()
        .selectExpr(f"explode(sequence(date_sub(day, {days - 1}), day)) AS date", "count")
        .groupBy("date")
        .agg(F.sum("count").alias("due"))
    )


def index_composition(chunks: DataFrame, collections: DataFrame) -> DataFrame:
    """Chunks, documents and share per collection; configured but empty collections stay visible.

    ``chunks`` (collection, source_path, ...), ``collections`` (collection, assist_level).
    """
    per_path = chunks.groupBy("collection", "source_path").agg(F.count("*").alias("n"))
    counts = per_path.groupBy("collection").agg(F.sum("n").alias("chunks"), F.count("*").alias("docs"))
    total = counts.agg(F.sum("chunks").alias("total"))
    return (
        collections.join(counts, "collection", "full_outer")
        .select("*", total.scalar().alias("total"))
        .selectExpr(
            "collection",
            "coalesce(assist_level, 'full') AS assist_level",
            "coalesce(docs, 0) AS docs",
            "coalesce(chunks, 0) AS chunks",
            "bround(coalesce(chunks, 0) / coalesce(total, 1) * 100, 1) AS share",
        )
    )


def file_types(chunks: DataFrame) -> DataFrame:
    """Rows per file extension with share."""
    counts = chunks.groupBy(
        F.expr("if(contains(source_path, '.'), lower(substring_index(source_path, '.', -1)), '(none)') AS ext")
    ).agg(F.count("*").alias("chunks"))
    total = counts.agg(F.sum("chunks").alias("total"))
    return counts.select("*", total.scalar().alias("total")).selectExpr(
        "ext", "chunks", "bround(chunks / total * 100, 1) AS share"
    )


def dashboard_totals(course_rows: DataFrame, composition: DataFrame) -> DataFrame:
    """One row of totals over ``by_course`` and ``index_composition``."""
    rows = course_rows.select("remaining", "exam", "quiz", "project").unionByName(
        composition.select("docs", "chunks", F.lit(1).alias("listed")), allowMissingColumns=True
    )
    return rows.agg(
        F.sum("remaining").alias("deadlines_remaining"),
        F.sum("exam").alias("exams_remaining"),
        F.sum("quiz").alias("quizzes_remaining"),
        F.sum("project").alias("projects_remaining"),
        F.sum("docs").alias("docs"),
        F.sum("chunks").alias("chunks"),
        F.expr("count_if(chunks > 0) AS collections_indexed"),
        F.count("listed").alias("collections_total"),
    )


def table_census(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def semester_progress(days: DataFrame) -> DataFrame:
    """How far each ``today`` lies through [start, end]: days, whole weeks and percent."""
    span = "if(datediff(end, start) = 0, 1, datediff(end, start))"
    return days.selectExpr(
        "*",
        f"{span} AS total_days",
        "greatest(0, datediff(today, start)) AS elapsed_days",
        "greatest(0, datediff(end, today)) AS days_remaining",
        "cast(greatest(0, floor(datediff(end, today) / 7)) AS int) AS weeks_remaining",
        f"bround(100 * greatest(0D, least(1D, datediff(today, start) / {span})), 1) AS pct_elapsed",
    )


def accept_window(items: DataFrame, today: str, cap: str | None = None, back: int = 30, ahead_days: int = 240) -> DataFrame:
    """Items dated within [today - back, min(today + ahead, cap)]."""
    hi = f"date_add(date'{today}', {ahead_days})"
    if cap:
        hi = f"least({hi}, date'{cap}')"
    return items.where(f"date BETWEEN date_sub(date'{today}', {back}) AND {hi}")
