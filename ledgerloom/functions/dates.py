"""Date expressions. Each returns SQL text for ``F.expr``."""

from __future__ import annotations


def term_name(day: str) -> str:
    """'2026 Fall' and the like."""
    return (
        f"concat(year({day}), ' ', CASE WHEN month({day}) >= 8 THEN 'Fall' WHEN month({day}) <= 5 THEN 'Spring'"
        f" ELSE 'Summer' END)"
    )


def term_start(day: str) -> str:
    first = f"CASE WHEN month({day}) >= 8 THEN 8 WHEN month({day}) <= 5 THEN 1 ELSE 5 END"
    return f"make_date(year({day}), {first}, 1)"


def term_end(day: str) -> str:
    last = f"CASE WHEN month({day}) >= 8 THEN 12 WHEN month({day}) <= 5 THEN 5 ELSE 8 END"
    return f"make_date(year({day}), {last}, 31)"


def utc_to_local(raw: str, zone: str = "America/New_York") -> str:
    """ISO text, UTC unless it names an offset, as a zone-less local time; null when unreadable."""
    suffix = "(Z|[+-][0-9]{2}:?[0-9]{2})$"
    naive = f"try_cast(regexp_replace({raw}, '{suffix}', '') AS timestamp_ntz)"
    offset = "([+-])([0-9]{2}):?([0-9]{2})$"
    part = lambda n: f"cast(regexp_extract({raw}, 'T.*{offset}', {n}) AS int)"
    minutes = (
        f"CASE WHEN rlike({raw}, 'T.*{offset}') THEN"
        f" if(regexp_extract({raw}, 'T.*{offset}', 1) = '-', -1, 1) * ({part(2)} * 60 + {part(3)}) ELSE 0 END"
    )
    return f"convert_timezone('UTC', '{zone}', {naive} - make_dt_interval(0, 0, {minutes}))"


def clock(ts: str) -> str:
    return f"date_format({ts}, 'HH:mm')"


def iso_text(ts: str) -> str:
    """ISO-8601 text; microseconds only when there are any."""
    return (
        f"if(date_format({ts}, 'SSSSSS') = '000000', date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss\"),"
        f" date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"))"
    )
