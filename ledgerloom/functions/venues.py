"""Opening days and clock times of venues. Each function returns SQL text for ``F.expr``."""

from __future__ import annotations

# Day names, Monday = 0.
DAY_NAMES = {
    "mon": 0, "monday": 0, "tue": 1, "tues": 1, "tuesday": 1, "wed": 2, "weds": 2, "wednesday": 2,
    "thu": 3, "thur": 3, "thurs": 3, "thursday": 3, "fri": 4, "friday": 4, "sat": 5, "saturday": 5,
    "sun": 6, "sunday": 6,
}
DAY_LABELS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
EVERY_DAY = ["daily", "every day", "everyday", "7 days"]
CLOSING_MINUTE = 1380  # an open-ended venue is taken to close at 23:00


def parse_days(spec: str) -> str:
    """Weekday numbers of 'Tue-Fri', 'Mon, Wed' or 'daily'; empty when any part is unreadable."""
    names = "map(" + ", ".join(f"'{k}', {v}" for k, v in DAY_NAMES.items()) + ")"
    s = f"lower(trim(coalesce({spec}, '')))"
    parts = f"filter(transform(split(replace(replace({s}, '&', ','), ' and ', ','), ','), p -> trim(replace(p, '–', '-'))), p -> p <> '')"
    lo = f"try_element_at({names}, trim(substring_index(p, '-', 1)))"
    hi = f"try_element_at({names}, trim(substring(p, instr(p, '-') + 1)))"
    days = (
        f"CASE WHEN NOT contains(p, '-') THEN if(try_element_at({names}, p) IS NULL, null, array(try_element_at({names}, p)))"
        f" WHEN {lo} IS NULL OR {hi} IS NULL THEN null"
        f" WHEN {lo} <= {hi} THEN sequence({lo}, {hi}) ELSE concat(sequence({lo}, 6), sequence(0, {hi})) END"
    )
    runs = f"transform({parts}, p -> {days})"
    every = ", ".join(f"'{x}'" for x in EVERY_DAY)
    return (
        f"CASE WHEN {s} IN ({every}) THEN sequence(0, 6) WHEN exists({runs}, r -> r IS NULL) THEN cast(array() AS array<int>)"
        f" ELSE array_sort(array_distinct(flatten({runs}))) END"
    )


def format_days(days: str) -> str:
    """'Tue-Fri', 'Mon, Wed', 'Daily'."""
    label = lambda d: f"element_at(array({', '.join(repr(x) for x in DAY_LABELS)}), {d} + 1)"
    # A run starts at a day whose eve is absent and ends at a day whose morrow is absent.
    starts = f"filter({days}, d -> NOT array_contains({days}, d - 1))"
    ends = f"filter({days}, d -> NOT array_contains({days}, d + 1))"
    one = f"if(a = b, {label('a')}, concat({label('a')}, '-', {label('b')}))"
    runs = f"array_join(zip_with({starts}, {ends}, (a, b) -> {one}), ', ')"
    return f"CASE WHEN size({days}) = 0 THEN 'days not confirmed' WHEN size({days}) = 7 THEN 'Daily' ELSE {runs} END"


def clock_minute(value: str) -> str:
    """Minute of the day of '16:00', '4:30 PM' or '4pm'; null when unreadable."""
    v = f"replace(lower(trim(coalesce({value}, ''))), ' ', '')"
    shape = "^([0-9]{1,2})(?::([0-9]{1,2}))?(am|pm)?$"
    h = f"cast(nullif(regexp_extract({v}, '{shape}', 1), '') AS int)"
    m = f"cast(nullif(regexp_extract({v}, '{shape}', 2), '') AS int)"
    half = f"regexp_extract({v}, '{shape}', 3)"
    return (
        f"CASE WHEN {h} IS NULL OR coalesce({m}, 0) > 59 THEN null"
        f" WHEN {half} = '' THEN if({m} IS NOT NULL AND {h} <= 23, {h} * 60 + {m}, null)"
        f" WHEN {h} BETWEEN 1 AND 12 THEN ({h} % 12 + if({half} = 'pm', 12, 0)) * 60 + coalesce({m}, 0) END"
    )


def clock_text(minute: str) -> str:
    hour = f"if({minute} div 60 % 12 = 0, 12, {minute} div 60 % 12)"
    return f"concat({hour}, ':', lpad({minute} % 60, 2, '0'), if({minute} < 720, ' AM', ' PM'))"


def window_text(start: str, end: str) -> str:
    return (
        f"CASE WHEN {start} IS NULL THEN 'time not confirmed' WHEN {end} IS NULL THEN concat('from ', {clock_text(start)})"
        f" ELSE concat({clock_text(start)}, ' - ', {clock_text(end)}) END"
    )


def venue_state(start: str, end: str, now_minute: int) -> str:
    return (
        f"CASE WHEN {start} IS NULL THEN 'upcoming'"
        f" WHEN {now_minute} >= {start} AND {now_minute} < coalesce({end}, {CLOSING_MINUTE}) THEN 'live'"
        f" WHEN {now_minute} < {start} AND {start} - {now_minute} <= 60 THEN 'soon'"
        f" WHEN {end} IS NOT NULL AND {now_minute} >= {end} THEN 'done' ELSE 'upcoming' END"
    )
