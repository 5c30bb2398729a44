"""Query keys of the timeline operators."""

from ledgerloom.operators import timeline as L
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import DEADLINES, with_
from ledgerloom.sources.tables import deadlines

ORDER_DAYS = """days AS (SELECT o_custkey, o_orderdate::DATE AS date, count(*) AS n FROM orders GROUP BY ALL),
gaps AS (SELECT *, CASE WHEN datediff('day', lag(date) OVER w, date) <= 7 THEN 0 ELSE 1 END AS is_start FROM days
  WINDOW w AS (PARTITION BY o_custkey ORDER BY date)),
isl AS (SELECT *, sum(is_start) OVER (PARTITION BY o_custkey ORDER BY date ROWS UNBOUNDED PRECEDING) AS stretch FROM gaps)"""


def order_days(t):
    return t.orders.selectExpr("o_custkey", "o_orderpriority AS course", "cast(o_orderdate AS date) AS date")


@query(
    "stretches",
    with_(ORDER_DAYS)
    + """SELECT i.o_custkey, i.stretch::BIGINT AS stretch, min(i.date) AS start, max(i.date) AS "end", count(*) AS dates,
count(DISTINCT o_orderpriority) AS courses, datediff('day', min(i.date), max(i.date)) + 1 AS span_days
FROM isl i JOIN orders o ON o.o_custkey = i.o_custkey AND o.o_orderdate::DATE = i.date GROUP BY i.o_custkey, i.stretch""",
)
def stretches(t):
    return L.stretches(order_days(t), ["o_custkey"])


@query(
    "stretch_sessions",
    with_(ORDER_DAYS)
    + """SELECT o_custkey, min(date) AS start, max(date) AS "end", sum(n)::BIGINT AS dates FROM isl GROUP BY o_custkey, stretch""",
)
def stretch_sessions(t):
    return L.stretches_by_session(order_days(t), ["o_custkey"])


@query(
    "clear_runs",
    """WITH days AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS date FROM orders WHERE o_orderdate >= '1998-01-01'),
g AS (SELECT o_custkey, lag(date) OVER (PARTITION BY o_custkey ORDER BY date) AS prev, date FROM days),
r AS (SELECT o_custkey, coalesce(prev, DATE '1998-01-01') AS from_day, date AS to_day,
  datediff('day', coalesce(prev, DATE '1998-01-01'), date) - 1 AS days, prev IS NULL AS lead_in FROM g)
SELECT * FROM r WHERE CASE WHEN lead_in THEN days >= 7 ELSE days >= 7 END""",
)
def clear_runs(t):
    return L.clear_runs(order_days(t), "1998-01-01", ["o_custkey"])


@query(
    "spread_days",
    with_(DEADLINES)
    + """, s AS (SELECT *, starts_at::DATE AS d0, CASE WHEN coalesce(ends_at, starts_at) > starts_at AND ends_at = date_trunc('day', ends_at)
  THEN (ends_at - INTERVAL 1 SECOND)::DATE ELSE coalesce(ends_at, starts_at)::DATE END AS d1 FROM deadlines)
SELECT id, course, title, d AS date, d > d0 AS continued FROM (
  SELECT *, unnest(generate_series(d0, least(d1, d0 + 399), INTERVAL 1 DAY))::DATE AS d FROM s)""",
)
def spread_days(t):
    return L.spread_days(deadlines(t.events))
