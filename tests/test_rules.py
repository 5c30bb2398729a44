"""Recurrence rules against a plain judge that looks at every day from the first start on."""

import calendar
import random
from datetime import date, datetime, timedelta

from ledgerloom.sources import calendars as C

CODES = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
FIRST, LAST = date(2024, 1, 8), date(2024, 5, 3)
SCHEMA = "id long, starts_at timestamp_ntz, ends_at timestamp_ntz, rrule string, rdates array<timestamp_ntz>, exdates array<timestamp_ntz>, error string"


def parsed(rule):
    parts = dict(p.split("=") for p in rule.split(";"))
    ints = lambda k: [int(x) for x in parts.get(k, "").split(",") if x]
    days = [(int(x[:-2] or 0), CODES.index(x[-2:])) for x in parts.get("BYDAY", "").split(",") if x]
    return parts["FREQ"], int(parts.get("INTERVAL", 1)), int(parts.get("COUNT", 0)), days, ints("BYMONTHDAY"), ints("BYMONTH"), ints("BYSETPOS"), CODES.index(parts.get("WKST", "MO"))


def period(freq, d, wkst):
    return {"DAILY": d.toordinal(), "WEEKLY": (d.toordinal() - 1 - wkst) // 7, "MONTHLY": d.year * 12 + d.month, "YEARLY": d.year}[freq]


def fits(d, d0, freq, days, mdays, months):
    size = calendar.monthrange(d.year, d.month)[1]
    if months and d.month not in months or mdays and d.day not in mdays and d.day - size - 1 not in mdays:
        return False
    if days:
        if freq == "MONTHLY" or months:
            at, back = -(-d.day // 7), -(-(size - d.day + 1) // 7)
        else:
            n, year = d.timetuple().tm_yday, 366 if calendar.isleap(d.year) else 365
            at, back = -(-n // 7), -(-(year - n + 1) // 7)
        return any(dow == d.weekday() and nth in (0, at, -back) for nth, dow in days)
    if mdays or freq == "DAILY":
        return True
    if freq == "WEEKLY":
        return d.weekday() == d0.weekday()
    return d.day == d0.day and (freq == "MONTHLY" or bool(months) or d.month == d0.month)


def plain(rule, d0):
    """Days inside the window, counting from the first start."""
    freq, step, count, days, mdays, months, places, wkst = parsed(rule)
    start, end = (d0, LAST) if freq == "DAILY" else (d0 - timedelta(days=400), LAST + timedelta(days=400))
    groups = {}
    for n in range((end - start).days + 1):
        d = start + timedelta(days=n)
        k = period(freq, d, wkst) - period(freq, d0, wkst)
        if k >= 0 and k % step == 0 and fits(d, d0, freq, days, mdays, months):
            groups.setdefault(k, []).append(d)
    out = []
    for _, found in sorted(groups.items()):
        out += [d for i, d in enumerate(found) if not places or i + 1 in places or i - len(found) in places]
    out = [d for d in out if d0 <= d <= LAST]
    return [d for d in (out[:count] if count else out) if d >= FIRST]


def some_rules(rng, n):
    for _ in range(n):
        freq = rng.choice(("DAILY", "WEEKLY", "MONTHLY", "YEARLY"))
        rule = [f"FREQ={freq}"]
        if rng.random() < 0.4:
            rule.append(f"INTERVAL={rng.randint(1, 5)}")
        if rng.random() < 0.3:
            rule.append(f"COUNT={rng.choice((1, 3, 20, 400, 3000))}")
        if rng.random() < 0.5:
            nth = lambda: rng.choice(("", "", "1", "2", "-1", "5", "-5", "-2")) if freq in ("MONTHLY", "YEARLY") else ""
            rule.append("BYDAY=" + ",".join(nth() + c for c in rng.sample(CODES, rng.randint(1, 4))))
        if freq != "WEEKLY" and rng.random() < 0.3:
            rule.append("BYMONTHDAY=" + ",".join(map(str, rng.sample([1, 2, 13, 15, 28, 29, 30, 31, -1, -2, -31], rng.randint(1, 4)))))
        if rng.random() < 0.3:
            rule.append("BYMONTH=" + ",".join(map(str, rng.sample(range(1, 13), rng.randint(1, 6)))))
        if freq != "DAILY" and rng.random() < 0.25:
            rule.append("BYSETPOS=" + ",".join(map(str, rng.sample([1, 2, 3, -1, -2, -3], rng.randint(1, 2)))))
        if freq == "WEEKLY" and rng.random() < 0.4:
            rule.append(f"WKST={rng.choice(CODES)}")
        yield ";".join(rule), date(rng.choice((1970, 1999, 2019, 2023, 2023, 2024)), rng.randint(1, 12), rng.choice((1, 15, 28, 29, 30)) if rng.random() < 0.5 else rng.randint(1, 28))


def valid_rules(rng, n):
    out = []
    while len(out) < n:
        try:
            out += list(some_rules(rng, 1))
        except ValueError:  # a 30 February
            continue
    return out


def test_random_rules(spark):
    rules = valid_rules(random.Random(4), 400)
    rows = [(i, datetime(d.year, d.month, d.day, 9), datetime(d.year, d.month, d.day, 10), rule, [], [], None) for i, (rule, d) in enumerate(rules)]
    found = {}
    for r in C.expand_rules(spark.createDataFrame(rows, SCHEMA), str(FIRST), str(LAST)).collect():
        found.setdefault(r.id, []).append(r.starts_at and r.starts_at.date())
        assert (r.starts_at is None) == (r.error is not None)
    for i, (rule, d0) in enumerate(rules):
        assert sorted(x for x in found[i] if x) == plain(rule, d0), (rule, d0)
    assert sum(len(v) for v in found.values()) > 2000


def test_a_rule_from_long_ago_steps_through_few_periods(spark):
    """Periods are counted from the window on, or as many as COUNT asks for."""
    rows = [(i, datetime(1970, 1, 5, 9), None, r, [], [], None) for i, r in enumerate(("FREQ=DAILY", "FREQ=WEEKLY;BYDAY=MO", "FREQ=DAILY;COUNT=5"))]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", f"transform(array(rrule), r -> {C._rule('UTC')})[0] AS p", "date'1970-01-05' AS d0", f"date'{FIRST}' AS first", f"date'{LAST}' AS last")
    assert [r[0] for r in frame.orderBy("id").selectExpr(f"size({C._periods()})").collect()] == [(LAST - FIRST).days + 1, 17, 7]


def test_rules_of_one_file_are_expanded_by_many_tasks(spark, tmp_path):
    """A table in one row group is read by one task; the rules are stepped through by all of them."""
    rows = spark.range(0, 400, 1, 1).selectExpr(
        "id", "timestamp_ntz'2024-01-01 10:00:00' AS starts_at", "timestamp_ntz'2024-01-01 11:00:00' AS ends_at", "'FREQ=WEEKLY;BYDAY=FR,MO' AS rrule",
        "cast(array() AS array<timestamp_ntz>) AS rdates", "cast(array() AS array<timestamp_ntz>) AS exdates", "cast(null AS string) AS error",
    )
    rows.write.parquet(str(tmp_path / "rules"))
    found = C.expand_rules(spark.read.parquet(str(tmp_path / "rules")), "2024-01-01", "2024-01-14")
    assert found.rdd.getNumPartitions() > 1
    days = [(r.starts_at.day, r.n) for r in found.groupBy("starts_at").count().withColumnRenamed("count", "n").orderBy("starts_at").collect()]
    assert days == [(d, 400) for d in (1, 5, 8, 12)]
