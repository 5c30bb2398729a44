"""Stretches of work, the clear runs between them, and multi-day spreading.

All take dated rows and optional grouping keys (a tenant, a customer). Rows are reduced to one per key
and day before any window runs, so a window holds at most one row per calendar day and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _day_islands(rows: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """(keys, date) -> stretch number: a new stretch starts when the gap exceeds ``gap`` days."""
    days = rows.groupBy(*keys, "date").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("date")
    starts = days.withColumn("prev", F.lag("date").over(w)).withColumn(
        "is_start", F.expr(f"if(prev IS NULL OR datediff(date, prev) > {gap}, 1, 0)")
    )
    return starts.withColumn("stretch", F.sum("is_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def stretches(rows: DataFrame, keys: Sequence[str] = (), gap: int = 7, course: str = "course") -> DataFrame:
    """Per stretch: first and last day, dated rows, distinct courses and span in days."""
    keys = list(keys)
    islands = _day_islands(rows, keys, gap)
    spans = islands.groupBy(*keys, "stretch").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.sum("n").alias("dates")
    )
    courses = (
        rows.select(*keys, "date", course)
        .distinct()
        .join(islands.select(*keys, "date", "stretch"), [*keys, "date"])
        .groupBy(*keys, "stretch")
        .agg(F.countDistinct(course).alias("courses"))
    )
    return spans.join(courses, [*keys, "stretch"]).withColumn("span_days", F.expr("datediff(end, start) + 1"))


def clear_runs(rows: DataFrame, today: str, keys: Sequence[str] = (), gap: int = 7) -> DataFrame:
    """Gaps between stretches, and the lead-in from ``today`` when it is at least ``gap`` days."""
    keys = list(keys)
    days = rows.where(f"date >= date'{today}'").groupBy(*keys, "date").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("date")
    gaps = days.withColumn("prev", F.lag("date").over(w)).selectExpr(
        *keys,
        f"coalesce(prev, date'{today}') AS from_day",
        "date AS to_day",
        f"datediff(date, coalesce(prev, date'{today}')) - 1 AS days",
        "prev IS NULL AS lead_in",
    )
    return gaps.where(f"if(lead_in, days >= {gap}, days + 1 > {gap})")


def stretches_by_session(rows: DataFrame, keys: Sequence[str] = (), gap: int = 7) -> DataFrame:
    """The same spans by ``session_window``, as the streaming twin computes them.

    Sessions merge when the next day equals the session end, so a gap of N days joins days at most N apart.
    """
    keys = list(keys)
    days = rows.groupBy(*keys, "date").agg(F.count("*").alias("n"))
    stamped = days.withColumn("at", F.expr("cast(date AS timestamp_ntz)"))
    return (
        stamped.groupBy(*keys, F.session_window("at", f"{gap} days"))
        .agg(F.min("date").alias("start"), F.max("date").alias("end"), F.sum("n").alias("dates"))
        .drop("session_window")
    )


def spread_days(events: DataFrame, guard: int = 400) -> DataFrame:
    """One row per day an event covers; an end at exactly midnight belongs to the day before."""
    end = "coalesce(ends_at, starts_at)"
    last = (
        f"cast(if({end} > starts_at AND {end} = cast(cast({end} AS date) AS timestamp_ntz),"
        f" {end} - INTERVAL '1' SECOND, {end}) AS date)"
    )
    spans = events.selectExpr("*", "cast(starts_at AS date) AS d0", f"{last} AS d1").where("d1 >= d0")
    return spans.selectExpr(
        "id", "course", "title", f"posexplode(sequence(d0, least(d1, date_add(d0, {guard - 1})))) AS (pos, date)"
    ).selectExpr("id", "course", "title", "date", "pos > 0 AS continued")
