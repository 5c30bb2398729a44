"""Deadline CSV files, recurring-rule rows and iCalendar bodies to calendar rows, with an error column.

Bad input never drops good rows: every row carries null or the reason it was refused.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import spread

CSV_COLUMNS = ["course", "title", "date", "start_time", "end_time", "all_day", "kind"]
CSV_KINDS = ("exam", "project", "quiz", "admin")
EVENT_KINDS = ("exam", "project", "quiz", "recurring", "admin")
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MAX_OCCURRENCES = 500


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def minute_of(time: str) -> str:
    """Minutes of 'H:MM' or 'HH:MM' in range, else null."""
    ok = f"rlike({time}, '^[0-9]{{1,2}}:[0-9]{{2}}$')"
    h, m = f"cast(split_part({time}, ':', 1) AS int)", f"cast(split_part({time}, ':', 2) AS int)"
    return f"CASE WHEN {ok} THEN if({h} <= 23 AND {m} <= 59, {h} * 60 + {m}, null) END"


def _csv_rows(text: str | None) -> tuple[bool, list[list[str]]]:
    """Whether the header is right, and the rows below it; blank lines are no rows, a quoted field may hold line breaks."""
    rows = [r for r in csv.reader(io.StringIO((text or "").lstrip("\ufeff"), newline="")) if r]
    header = [c.strip().lower() for c in rows[0]] if rows else []
    return header == CSV_COLUMNS, [[*r, *[""] * len(CSV_COLUMNS)][: len(CSV_COLUMNS)] for r in rows[1:]]


def _csv_fields(files: DataFrame) -> DataFrame:
    schema = "file string, line_no int, header_ok boolean, " + ", ".join(f"{c} string" for c in CSV_COLUMNS)
    names = ["file", "line_no", "header_ok", *CSV_COLUMNS]
    types = [pa.string(), pa.int32(), pa.bool_(), *[pa.string()] * len(CSV_COLUMNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    good, found = _csv_rows(text)
                except csv.Error:
                    good, found = False, [[""] * len(CSV_COLUMNS)]
                if not good and not found:
                    found = [[""] * len(CSV_COLUMNS)]  # a refused file is never silent
                rows.extend((file, n, good, *r) for n, r in enumerate(found, 2))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return files.select(F.col("file").cast("string"), "text").mapInArrow(run, schema)


def deadline_csv(files: DataFrame) -> DataFrame:
    """Deadline files (file, text) to calendar rows, numbered from 2. A file with any other header is refused as a whole."""
    header = ",".join(CSV_COLUMNS)
    fields = [f"trim(coalesce({c}, '')) AS {c}" for c in CSV_COLUMNS]
    rows = _csv_fields(files).selectExpr("file", "line_no", "header_ok", *fields).selectExpr(
        "file", "line_no", "header_ok", "course", "title", "start_time", "end_time", "date AS date_text",
        "if(rlike(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'), try_cast(date AS date), null) AS day",
        "lower(all_day) IN ('true', '1', 'yes') AS all_day", "lower(kind) AS kind",
        f"{minute_of('start_time')} AS sm", f"{minute_of('end_time')} AS em",
    )
    error = (
        f"CASE WHEN NOT header_ok THEN 'header must be exactly {header}'"
        " WHEN course = '' OR title = '' THEN 'course and title are required'"
        " WHEN day IS NULL THEN concat('date ', date_text, ' is not a date')"
        f" WHEN kind NOT IN ({_quoted(CSV_KINDS)}) THEN concat('kind ', kind, ' is not one of {'|'.join(CSV_KINDS)}')"
        " WHEN all_day THEN null"
        " WHEN start_time = '' THEN 'all_day is false but start_time is empty'"
        " WHEN sm IS NULL THEN concat('time ', start_time, ' is not a time')"
        " WHEN end_time <> '' AND em IS NULL THEN concat('time ', end_time, ' is not a time')"
        " WHEN end_time <> '' AND em <= sm THEN concat('end_time ', end_time, ' is not after start_time ', start_time) END"
    )
    at = lambda m: f"cast(day AS timestamp_ntz) + make_dt_interval(0, 0, {m})"
    return rows.withColumn("error", F.expr(error)).selectExpr(
        "file", "line_no", "course", "title", "all_day", "kind",
        f"CASE WHEN error IS NULL THEN if(all_day, cast(day AS timestamp_ntz), {at('sm')}) END AS starts_at",
        f"CASE WHEN error IS NULL AND NOT all_day AND end_time <> '' THEN {at('em')} END AS ends_at",
        "error",
    )


def validate_rules(rules: DataFrame) -> DataFrame:
    """Recurring-rule rows (rule_id, course, title, weekdays array<string>, start_time, end_time, kind) with weekday
    numbers and an error column."""
    numbers = "map(" + ", ".join(f"'{d}', {i}, '{d[:3]}', {i}" for i, d in enumerate(WEEKDAYS)) + ")"
    rows = rules.selectExpr(
        "*", f"transform(weekdays, w -> try_element_at({numbers}, lower(trim(w)))) AS nums", f"{minute_of('start_time')} AS sm", f"{minute_of('end_time')} AS em"
    )
    error = (
        "CASE WHEN coalesce(course, '') = '' OR coalesce(title, '') = '' THEN 'missing course or title'"
        " WHEN exists(nums, n -> n IS NULL) THEN 'unknown weekday'"
        " WHEN sm IS NULL OR em IS NULL THEN 'unreadable time'"
        " WHEN em <= sm THEN concat('end time ', end_time, ' is not after start ', start_time)"
        f" WHEN coalesce(kind, 'recurring') NOT IN ({_quoted(EVENT_KINDS)}) THEN concat('unknown kind ', kind) END"
    )
    return rows.withColumn("error", F.expr(error)).selectExpr(
        "rule_id", "course", "title", "if(error IS NULL, array_sort(array_distinct(nums)), null) AS weekdays", "start_time", "end_time",
        "coalesce(kind, 'recurring') AS kind", "error",
    )


# ------------------------------------------------------------------ iCalendar

def _property(name: str) -> str:
    """Value of the first line of a property in an unfolded VEVENT body."""
    return f"regexp_extract(v, '(?m)^{name}(?:;[^:\\\\r\\\\n]*)?:([^\\\\r\\\\n]*)', 1)"


def _all(name: str, group: int) -> str:
    """Parameters (1) or values (2) of every line of a property, as an array."""
    return f"regexp_extract_all(v, '(?m)^{name}((?:;[^:\\\\r\\\\n]*)?):([^\\\\r\\\\n]*)', {group})"


def _params(name: str) -> str:
    return f"regexp_extract(v, '(?m)^{name}((?:;[^:\\\\r\\\\n]*)?):', 1)"


def basic_time(value: str) -> str:
    """'20260908' or '20260908T120000' as a zone-less time, null when unreadable; a trailing Z is left out."""
    part = lambda at, n=2: f"substr({value}, {at}, {n})"
    day, clock = f"{part(1, 4)}, '-', {part(5)}, '-', {part(7)}", f"{part(10)}, ':', {part(12)}, ':', {part(14)}"
    return f"try_cast(CASE WHEN rlike({value}, '^[0-9]{{8}}(T[0-9]{{6}}Z?)?$') THEN if(length({value}) = 8, concat({day}), concat({day}, ' ', {clock})) END AS timestamp_ntz)"


# Zone names of Windows calendars and what they are called elsewhere.
WINDOWS_ZONES = {
    "UTC": "UTC", "GMT Standard Time": "Europe/London", "Greenwich Standard Time": "Atlantic/Reykjavik",
    "W. Europe Standard Time": "Europe/Berlin", "Central Europe Standard Time": "Europe/Budapest",
    "Central European Standard Time": "Europe/Warsaw", "Romance Standard Time": "Europe/Paris", "GTB Standard Time": "Europe/Bucharest",
    "E. Europe Standard Time": "Europe/Chisinau", "FLE Standard Time": "Europe/Kiev", "Russian Standard Time": "Europe/Moscow",
    "Turkey Standard Time": "Europe/Istanbul", "Israel Standard Time": "Asia/Jerusalem", "Egypt Standard Time": "Africa/Cairo",
    "South Africa Standard Time": "Africa/Johannesburg", "Arabian Standard Time": "Asia/Dubai", "India Standard Time": "Asia/Kolkata",
    "China Standard Time": "Asia/Shanghai", "Singapore Standard Time": "Asia/Singapore", "Tokyo Standard Time": "Asia/Tokyo",
    "Korea Standard Time": "Asia/Seoul", "AUS Eastern Standard Time": "Australia/Sydney", "E. Australia Standard Time": "Australia/Brisbane",
    "W. Australia Standard Time": "Australia/Perth", "New Zealand Standard Time": "Pacific/Auckland", "Hawaiian Standard Time": "Pacific/Honolulu",
    "Alaskan Standard Time": "America/Anchorage", "Pacific Standard Time": "America/Los_Angeles", "US Mountain Standard Time": "America/Phoenix",
    "Mountain Standard Time": "America/Denver", "Central Standard Time": "America/Chicago", "Central America Standard Time": "America/Guatemala",
    "Eastern Standard Time": "America/New_York", "US Eastern Standard Time": "America/Indianapolis", "Atlantic Standard Time": "America/Halifax",
    "Newfoundland Standard Time": "America/St_Johns", "SA Pacific Standard Time": "America/Bogota", "E. South America Standard Time": "America/Sao_Paulo",
    "Argentina Standard Time": "America/Buenos_Aires",
}
_ZONES = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in WINDOWS_ZONES.items()) + ")"


def zone_name(params: str) -> str:
    """What a property's zone is called: '' when it names none."""
    return f"transform(array(trim(regexp_extract({params}, 'TZID=\"?([^;:\"]+)', 1))), z -> if(z = '', '', coalesce(try_element_at({_ZONES}, z), z)))[0]"


def known_zone(name: str) -> str:
    """A zone by its name: null when it is not known."""
    known = f"try_to_timestamp(concat('2024-01-01 00:00:00 ', {name}), 'yyyy-MM-dd HH:mm:ss VV') IS NOT NULL"
    return f"CASE WHEN {name} = '' THEN '' WHEN {known} THEN {name} END"


def ics_time(value: str, local: str, named_zone: str, zone: str) -> str:
    """iCalendar date or date-time as a zone-less time in ``zone``; floating times stay as they are, unknown zones give null.

    ``local`` is the time as it is written.
    """
    return (
        f"CASE WHEN endswith({value}, 'Z') THEN convert_timezone('UTC', '{zone}', {local})"
        f" WHEN {named_zone} = '' THEN {local} WHEN {named_zone} IS NOT NULL THEN convert_timezone({named_zone}, '{zone}', {local}) END"
    )


def unescape_ics(value: str) -> str:
    return f"replace(replace(replace(replace({value}, '\\\\n', '\\n'), '\\\\,', ','), '\\\\;', ';'), '\\\\\\\\', '\\\\')"


def ics_events(feeds: DataFrame, zone: str = "UTC") -> DataFrame:
    """VEVENTs of iCalendar bodies (feed, body): one row per VEVENT with its rules and an error column.

    The end comes from DTEND or DURATION; an all-day DTEND is exclusive and moves back a day, never before the start.
    Several RRULE lines are kept, one per line. Alarms inside an event are not the event's properties. A zone that is
    not known makes an error row.
    """
    unfolded = "regexp_replace(body, '\\r?\\n[ \\t]', '')"
    vevents = feeds.select("feed", F.expr(f"posexplode_outer(slice(split({unfolded}, 'BEGIN:VEVENT'), 2, 1000000000)) AS (n, v0)")).where("n IS NOT NULL").selectExpr(
        "feed", "n", "regexp_replace(split_part(v0, 'END:VEVENT', 1), '(?s)BEGIN:VALARM.*?END:VALARM', '') AS v"
    )
    # Each value is parsed in a column of its own and used by name, so nothing is parsed twice.
    listed = lambda k: f"if(contains(v, '{k}'), zip_with({_all(k, 1)}, {_all(k, 2)}, (p, x) -> struct({zone_name('p')} AS name, x AS x)), null)"
    fields = vevents.selectExpr(
        "feed", "n",
        f"coalesce(nullif(trim({unescape_ics(_property('SUMMARY'))}), ''), '(untitled)') AS title",
        f"{unescape_ics(_property('CATEGORIES'))} AS categories",
        f"trim({_property('DTSTART')}) AS st", f"{zone_name(_params('DTSTART'))} AS sn", f"trim({_property('DTEND')}) AS et", f"{zone_name(_params('DTEND'))} AS en",
        f"if(contains(v, 'DURATION'), {_property('DURATION')}, '') AS dur", f"if(contains(v, 'RRULE'), array_join({_all('RRULE', 2)}, '\n'), '') AS rrule",
        f"{listed('RDATE')} AS rdate", f"{listed('EXDATE')} AS exdate",
    ).selectExpr(
        "*", f"{known_zone('sn')} AS sz", f"{basic_time('st')} AS sl", f"{basic_time('et')} AS el",
        *(f"transform({c}, l -> struct(l.x AS x, {known_zone('l.name')} AS z)) AS {c}_lines" for c in ("rdate", "exdate")),
    ).selectExpr("*", f"CASE WHEN en = sn THEN sz ELSE {known_zone('en')} END AS ez")
    part = lambda unit: f"coalesce(try_cast(nullif(regexp_extract(dur, '([0-9]+){unit}', 1), '') AS int), 0)"
    span = f"if(dur = '', null, make_dt_interval({part('W')} * 7 + {part('D')}, {part('H')}, {part('M')}, {part('S')}))"
    timed = fields.selectExpr(
        "*", f"{ics_time('st', 'sl', 'sz', zone)} AS starts_at", "length(st) = 8 AS all_day", f"{ics_time('et', 'el', 'ez', zone)} AS dtend", f"{span} AS span"
    )
    # A listed date without a time means the occurrence of that day.
    clock = "if(length(x) = 8 AND NOT all_day, concat(x, date_format(starts_at, \"'T'HHmmss\")), x)"
    values = f"transform(transform(split(l.x, ','), x -> trim(x)), x -> struct(x AS x, {basic_time(clock)} AS local))"
    dates = lambda c: (
        f"coalesce(filter(flatten(transform({c}_lines, l -> transform({values}, y -> {ics_time('y.x', 'y.local', 'l.z', zone)}))), t -> t IS NOT NULL), array())"
    )
    return timed.selectExpr(
        "feed", "n", "title", "categories", "starts_at",
        "CASE WHEN et <> '' AND all_day THEN greatest(dtend - INTERVAL '1' DAY, starts_at) WHEN et <> '' THEN dtend WHEN dur <> '' THEN starts_at + span END AS ends_at",
        "all_day", "nullif(rrule, '') AS rrule", f"{dates('rdate')} AS rdates", f"{dates('exdate')} AS exdates",
        "CASE WHEN st = '' THEN concat('VEVENT ', title, ' has no DTSTART; skipped') WHEN sz IS NULL THEN concat('VEVENT ', title, ': unknown time zone')"
        " WHEN starts_at IS NULL THEN concat('VEVENT ', title, ': unreadable DTSTART ', st) END AS error",
    )


# ------------------------------------------------------------------ recurrence rules

_CODES = "array('MO','TU','WE','TH','FR','SA','SU')"
#: The parts of a rule that are read. Any other makes the rule an error row.
RULE_PARTS = ("FREQ", "INTERVAL", "COUNT", "UNTIL", "BYDAY", "BYMONTHDAY", "BYMONTH", "BYSETPOS", "WKST")


def _rule_part(key: str) -> str:
    return f"regexp_extract(r, '(?:^|;){key}=([^;]*)', 1)"


def _rule(zone: str) -> str:
    """SQL text: a rule line ``r`` as a struct; ``bad`` where a part is unknown or cannot be read."""
    ints = lambda k: f"transform(filter(split({_rule_part(k)}, ','), x -> x <> ''), x -> try_cast(x AS int))"
    number = lambda k: f"try_cast(nullif({_rule_part(k)}, '') AS int)"
    days = f"filter(split({_rule_part('BYDAY')}, ','), x -> x <> '')"
    given = f"if(length({_rule_part('UNTIL')}) = 8, concat({_rule_part('UNTIL')}, 'T235959'), {_rule_part('UNTIL')})"
    freq = _rule_part("FREQ")
    bad = (
        f"exists(split(r, ';'), p -> p <> '' AND split_part(p, '=', 1) NOT IN ({_quoted(RULE_PARTS)})) OR {freq} NOT IN ('DAILY', 'WEEKLY', 'MONTHLY', 'YEARLY')"
        f" OR exists({days}, x -> NOT rlike(x, '^[+-]?[0-9]*(MO|TU|WE|TH|FR|SA|SU)$')) OR ({freq} IN ('DAILY', 'WEEKLY') AND exists({days}, x -> length(x) > 2))"
        f" OR ({freq} = 'WEEKLY' AND {_rule_part('BYMONTHDAY')} <> '') OR ({_rule_part('INTERVAL')} <> '' AND coalesce({number('INTERVAL')}, 0) < 1)"
        f" OR ({_rule_part('COUNT')} <> '' AND coalesce({number('COUNT')}, 0) < 1) OR ({_rule_part('UNTIL')} <> '' AND {basic_time(given)} IS NULL)"
        + "".join(f" OR exists({ints(k)}, x -> x IS NULL)" for k in ("BYMONTHDAY", "BYMONTH", "BYSETPOS"))
        + f" OR ({_rule_part('WKST')} <> '' AND NOT array_contains({_CODES}, {_rule_part('WKST')}))"
    )
    until = f"CASE WHEN endswith({given}, 'Z') THEN convert_timezone('UTC', '{zone}', {basic_time(given)}) ELSE {basic_time(given)} END"
    by_day = f"transform({days}, x -> struct(coalesce(try_cast(nullif(left(x, length(x) - 2), '') AS int), 0) AS nth, array_position({_CODES}, right(x, 2)) - 1 AS dow))"
    return (
        f"struct({freq} AS freq, coalesce({number('INTERVAL')}, 1) AS step, {number('COUNT')} AS n_max, {until} AS until, {by_day} AS days,"
        f" {ints('BYMONTHDAY')} AS mdays, {ints('BYMONTH')} AS months, {ints('BYSETPOS')} AS places,"
        f" greatest(array_position({_CODES}, {_rule_part('WKST')}) - 1, 0) AS wkst, ({bad}) AS bad)"
    )


# Number of the period a day lies in, counted from the period of the first start.
_PERIOD = (
    "CASE p.freq WHEN 'DAILY' THEN datediff(d, d0) WHEN 'WEEKLY' THEN cast(floor((datediff(d, date'1970-01-05') - p.wkst) / 7)"
    " - floor((datediff(d0, date'1970-01-05') - p.wkst) / 7) AS int)"
    " WHEN 'MONTHLY' THEN (year(d) - year(d0)) * 12 + month(d) - month(d0) ELSE year(d) - year(d0) END"
)
_IN_MONTH = "(p.freq = 'MONTHLY' OR size(p.months) > 0)"
_NTH = (
    f"b.nth = 0 OR b.nth = if({_IN_MONTH}, if(b.nth > 0, ceil(day(d) / 7), -ceil((day(last_day(d)) - day(d) + 1) / 7)),"
    " if(b.nth > 0, ceil(dayofyear(d) / 7), -ceil((dayofyear(make_date(year(d), 12, 31)) - dayofyear(d) + 1) / 7)))"
)
_FITS = (
    "(size(p.months) = 0 OR array_contains(p.months, month(d)))"
    " AND (size(p.mdays) = 0 OR array_contains(p.mdays, day(d)) OR array_contains(p.mdays, day(d) - day(last_day(d)) - 1))"
    f" AND (size(p.days) = 0 OR exists(p.days, b -> b.dow = weekday(d) AND ({_NTH})))"
    " AND (size(p.days) > 0 OR size(p.mdays) > 0 OR CASE p.freq WHEN 'WEEKLY' THEN weekday(d) = weekday(d0) WHEN 'MONTHLY' THEN day(d) = day(d0)"
    " WHEN 'YEARLY' THEN day(d) = day(d0) AND (size(p.months) > 0 OR month(d) = month(d0)) ELSE true END)"
)
# What rows start with: the first day that can matter. COUNT runs from the first start, all else from the window.
_FIRST = "if(p.n_max IS NULL, greatest(d0, first), d0)"
_WEEK0 = "date_sub(d0, cast(pmod(weekday(d0) - p.wkst, 7) AS int))"
#: Every period that counts has an occurrence, so as many periods as COUNT asks for are enough.
_DENSE = (
    "size(p.months) = 0 AND size(p.mdays) = 0 AND size(p.places) = 0 AND CASE p.freq WHEN 'WEEKLY' THEN true WHEN 'DAILY' THEN size(p.days) = 0"
    " ELSE if(size(p.days) > 0, forall(p.days, b -> abs(b.nth) <= 4), day(d0) <= 28) END"
)
_LAST_K = f"if(p.n_max IS NOT NULL AND {_DENSE}, least({{k}}, cast(p.step AS bigint) * (p.n_max + 1)), {{k}})"


def _periods() -> str:
    """SQL text: numbers of the periods that count, from the first that can matter to the last."""
    number = lambda day: f"transform(array({day}), d -> {_PERIOD})[0]"
    span = f"transform(array(struct(cast(ceil({number(_FIRST)} / p.step) AS bigint) * p.step AS lo, cast({_LAST_K.format(k=number('last'))} AS bigint) AS hi))"
    return f"flatten({span}, b -> if(last < d0 OR b.lo > b.hi, cast(array() AS array<bigint>), sequence(b.lo, b.hi, cast(p.step AS bigint)))))"


# The stretches of days of a period that its rule picks days from: one month, some months of a year, or a year.
_MONTH = "struct({m} AS lo, last_day({m}) AS hi)"
_STRETCHES = (
    f"CASE WHEN p.freq = 'MONTHLY' THEN transform(array(add_months(trunc(d0, 'MM'), cast(k AS int))), m -> {_MONTH.format(m='m')})"
    f" WHEN size(p.months) > 0 THEN transform(filter(p.months, x -> x BETWEEN 1 AND 12), x -> {_MONTH.format(m='make_date(cast(year(d0) + k AS int), x, 1)')})"
    f" WHEN size(p.mdays) > 0 THEN transform(sequence(1, 12), x -> {_MONTH.format(m='make_date(cast(year(d0) + k AS int), x, 1)')})"
    " WHEN size(p.days) > 0 THEN array(struct(make_date(cast(year(d0) + k AS int), 1, 1) AS lo, make_date(cast(year(d0) + k AS int), 12, 31) AS hi))"
    f" ELSE array({_MONTH.format(m='make_date(cast(year(d0) + k AS int), month(d0), 1)')}) END"
)
# The days a stretch offers: by number, by weekday (the n-th from either end or all), or the day of the first start.
_ON_DAY = "date_add(s.lo, cast(pmod(b.dow - weekday(s.lo), 7) AS int))"
_ON_DAY_BACK = "date_sub(s.hi, cast(pmod(weekday(s.hi) - b.dow, 7) AS int))"
_OFFERED = (
    "filter(CASE WHEN size(p.mdays) > 0 THEN transform(p.mdays, x -> if(x > 0, date_add(s.lo, x - 1), date_add(s.hi, x + 1)))"
    f" WHEN size(p.days) > 0 THEN flatten(transform(p.days, b -> CASE WHEN b.nth = 0 THEN sequence({_ON_DAY}, s.hi, INTERVAL 7 DAYS)"
    f" WHEN b.nth > 0 THEN array(date_add({_ON_DAY}, 7 * (b.nth - 1))) ELSE array(date_sub({_ON_DAY_BACK}, 7 * (-b.nth - 1))) END))"
    " ELSE array(date_add(s.lo, day(d0) - 1)) END, d -> d BETWEEN s.lo AND s.hi)"
)
_CANDIDATES = (
    "CASE p.freq WHEN 'DAILY' THEN array(date_add(d0, cast(k AS int)))"
    f" WHEN 'WEEKLY' THEN transform(if(size(p.days) > 0, p.days, array(struct(0 AS nth, weekday(d0) AS dow))), b -> date_add({_WEEK0}, cast(7 * k + pmod(b.dow - p.wkst, 7) AS int)))"
    f" ELSE flatten(transform({_STRETCHES}, s -> {_OFFERED})) END"
)


def expand_rules(events: DataFrame, window_start: str, window_end: str, cap: int = MAX_OCCURRENCES, zone: str = "UTC") -> DataFrame:
    """Occurrences of recurring rows inside the window.

    Rows need starts_at, ends_at, rrule, rdates, exdates, error; ``rrule`` may hold several rules, one per line. Read are
    DAILY, WEEKLY, MONTHLY and YEARLY rules with INTERVAL, COUNT, UNTIL, BYDAY (numbered too), BYMONTHDAY, BYMONTH,
    BYSETPOS and WKST. Any other rule is an error row, as is a rule without an occurrence in the window. COUNT runs
    from the first start; EXDATE does not extend it. UNTIL in UTC is taken in ``zone``. A rule is stepped through by whole
    periods, from the window on where it has no COUNT, so a rule that began long ago costs no more than a new one.
    """
    end = f"timestamp_ntz'{window_end} 23:59:59'"
    rows = spread(events).selectExpr(
        "*", f"transform(filter(split(rrule, '\\n'), r -> r <> ''), r -> {_rule(zone)}) AS rules", "cast(starts_at AS date) AS d0",
        "starts_at - cast(cast(starts_at AS date) AS timestamp_ntz) AS tod", "ends_at - starts_at AS span",
        "rrule IS NOT NULL OR size(coalesce(rdates, array())) > 0 AS recurs", f"cast({end} AS date) AS last", f"date'{window_start}' AS first",
    ).withColumn("error", F.expr("coalesce(error, if(exists(rules, p -> p.bad), concat('unsupported rule ', rrule), null))"))
    # The days of each period that counts, then the places in it, then the times.
    # Sorted natively, and only where a period has several days; a comparator would be interpreted for each pair.
    found = f"filter({_CANDIDATES}, d -> {_FITS})"
    picked = f"transform(array({found}), c -> if(size(c) > 1, sort_array(array_distinct(c)), c))[0]"
    days = f"transform({_periods()}, k -> {picked})"
    placed = "if(size(p.places) = 0, c, filter(c, (d, i) -> exists(p.places, n -> n = i + 1 OR n = i - size(c))))"
    stamps = f"filter(transform(filter(flatten(transform(cs, c -> {placed})), d -> d >= d0), d -> cast(d AS timestamp_ntz) + tod), t -> (p.until IS NULL OR t <= p.until) AND t <= {end})"
    staged = rows.withColumn("days", F.expr(f"if(error IS NULL, transform(rules, p -> {days}), null)"))
    staged = staged.withColumn("sets", F.expr(f"zip_with(rules, days, (p, cs) -> {stamps})"))
    counted = "flatten(zip_with(rules, sets, (p, s) -> if(p.n_max IS NULL, s, slice(s, 1, p.n_max))))"
    merged = f"array_except(sort_array(array_distinct(concat(coalesce({counted}, array()), coalesce(rdates, array())))), coalesce(exdates, array()))"
    inside = f"t >= timestamp_ntz'{window_start} 00:00:00' AND t <= {end}"
    starts = f"CASE WHEN error IS NOT NULL THEN cast(array() AS array<timestamp_ntz>) WHEN recurs THEN slice(filter({merged}, t -> {inside}), 1, {cap}) ELSE array(starts_at) END"
    staged = staged.withColumn("starts", F.expr(starts))
    keep = [c for c in events.columns if c not in ("starts_at", "ends_at", "rrule", "rdates", "exdates", "error")]
    return staged.withColumn(
        "error", F.expr(f"coalesce(error, if(size(starts) = 0, 'recurs but has no occurrence inside {window_start}..{window_end}', null))")
    ).select(*keep, "error", "span", F.explode_outer("starts").alias("starts_at")).selectExpr(
        *keep, "starts_at", "starts_at + span AS ends_at", "error"
    )
