"""Raw site payloads to typed rows. Each source takes rows with a JSON ``payload`` column, one payload per row.

Reading is tolerant: unknown fields are ignored, unreadable dates drop the item, as the sites are not ours.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.dates import term_name, utc_to_local
from ledgerloom.functions.titles import classify_connector, ensure_where

BACK_DAYS, AHEAD_DAYS = 30, 240
# Fixed value: prefix a proctoring tool puts in front of titles.
PROCTOR = "'(?i)^\\\\s*proctoring enabled:\\\\s*'"
# Grade objects that only sum up other ones.
AGGREGATE_TYPES = (5, 7, 8, 9)
VHL_DUE = "12:55"
TOPIC_ARROW = pa.schema(
    [("course", pa.string()), ("path", pa.list_(pa.string())), *((n, pa.string()) for n in ("Title", "Url", "TypeIdentifier", "Identifier"))]
)


def window(column: str, today: str, cap: str | None = None) -> str:
    hi = f"date_add(date'{today}', {AHEAD_DAYS})"
    hi = f"least({hi}, date'{cap}')" if cap else hi
    return f"{column} BETWEEN date_sub(date'{today}', {BACK_DAYS}) AND {hi}"


def flat_code(text: str) -> str:
    """'finc 313' and 'FINC-313' are the same course code."""
    return f"regexp_replace(upper({text}), '[^A-Z0-9]', '')"


def exploded(raw: DataFrame, element: str, *keep: str) -> DataFrame:
    """One row per element of a JSON array payload."""
    # An outer generator: for an inner one the optimizer adds a filter on the array's size and parses every payload twice.
    found = raw.select(*keep, F.expr(f"posexplode_outer(from_json(payload, 'array<{element}>')) AS (_at, r)"))
    return found.where("_at IS NOT NULL").select(*keep, "r.*")


def enrollments(raw: DataFrame, courses: DataFrame, today: str) -> DataFrame:
    """Current-term course offerings mapped to configured courses. raw (tenant, payload), courses (course)."""
    items = raw.select(
        "tenant",
        F.expr("explode(from_json(payload, 'Items array<struct<OrgUnit: struct<Id: bigint, Name: string, Type: struct<Code: string>>>>').Items) AS i"),
    ).selectExpr("tenant", "i.OrgUnit.Id AS ou_id", "i.OrgUnit.Name AS name", "i.OrgUnit.Type.Code AS type")
    code = "'\\\\(([A-Za-z]{2,5})-([0-9]{3})'"
    current = items.where("type = 'Course Offering'").where(f"contains(name, {term_name(f'''date'{today}' ''')})").selectExpr(
        "tenant", "ou_id", f"upper(concat(regexp_extract(name, {code}, 1), regexp_extract(name, {code}, 2))) AS code"
    )
    wanted = courses.selectExpr("course", f"{flat_code('course')} AS code")
    return current.where("code <> ''").join(wanted, "code").select("tenant", "ou_id", "course")


def calendar_events(raw: DataFrame, today: str, cap: str | None = None) -> DataFrame:
    """Calendar events of a course site as items. raw (course, payload)."""
    shape = (
        "struct<Title: string, StartDateTime: string, EndDateTime: string, IsAllDayEvent: boolean, IsRecurring: boolean,"
        " CalendarEventId: string, CalendarEventViewUrl: string>"
    )
    rows = exploded(raw, shape, "course").selectExpr(
        "*", f"regexp_replace(trim(Title), {PROCTOR}, '') AS title0",
        f"{utc_to_local('StartDateTime')} AS s", f"{utc_to_local('EndDateTime')} AS e",
    )
    rows = rows.where("title0 <> '' AND s IS NOT NULL").where(window("cast(s AS date)", today, cap)).selectExpr(
        "*", f"{classify_connector('title0')} AS kind", "coalesce(IsAllDayEvent, false) AS all_day"
    )
    same_day_end = "EndDateTime <> StartDateTime AND NOT all_day AND cast(e AS date) = cast(s AS date)"
    return rows.where("NOT (kind = 'admin' AND coalesce(IsRecurring, false))").selectExpr(
        "course", f"{ensure_where('title0', 'details on OAKS')} AS title", "cast(s AS date) AS date",
        "if(all_day, '', date_format(s, 'HH:mm')) AS start_time", f"if({same_day_end}, date_format(e, 'HH:mm'), '') AS end_time",
        "all_day", "kind", "coalesce(CalendarEventId, '') AS external_id",
    )


def quizzes(raw: DataFrame, today: str, cap: str | None = None) -> DataFrame:
    """Quiz records that state a due date, with every time and date of their window. raw (course, payload)."""
    rows = exploded(raw, "struct<QuizId: string, Name: string, StartDate: string, DueDate: string, EndDate: string>", "course").selectExpr(
        "*", f"regexp_replace(trim(Name), {PROCTOR}, '') AS name0", f"{utc_to_local('DueDate')} AS due",
        f"filter(array({utc_to_local('StartDate')}, {utc_to_local('DueDate')}, {utc_to_local('EndDate')}), x -> x IS NOT NULL) AS stamps",
    )
    return rows.where("name0 <> '' AND due IS NOT NULL").where(window("cast(due AS date)", today, cap)).selectExpr(
        "course", f"{ensure_where('name0', 'on OAKS')} AS title", "cast(due AS date) AS date", "date_format(due, 'HH:mm') AS start_time",
        f"{classify_connector('name0')} AS kind", "concat('quiz-', coalesce(QuizId, '')) AS external_id",
        "array_sort(array_distinct(transform(stamps, x -> date_format(x, 'HH:mm')))) AS known_times",
        "array_sort(array_distinct(transform(stamps, x -> cast(x AS date)))) AS known_dates",
    )


def dropboxes(raw: DataFrame, today: str, cap: str | None = None) -> DataFrame:
    """Dated submission folders. raw (course, payload)."""
    rows = exploded(raw, "struct<Id: string, Name: string, DueDate: string>", "course").selectExpr("*", f"{utc_to_local('DueDate')} AS due")
    return rows.where("trim(Name) <> '' AND due IS NOT NULL").where(window("cast(due AS date)", today, cap)).selectExpr(
        "course", f"{ensure_where('trim(Name)', 'submit on OAKS')} AS title", "cast(due AS date) AS date",
        "date_format(due, 'HH:mm') AS start_time", "'project' AS kind", "concat('dropbox-', coalesce(Id, '')) AS external_id",
    )


def publisher_assignments(sections: DataFrame, courses: DataFrame, assignments: DataFrame, wanted: DataFrame, today: str, cap: str | None = None) -> DataFrame:
    """Assignments of a publisher's site: assignment -> section -> configured course.

    Each input is a table of payloads; ``wanted`` (course) are the configured courses. A section belongs to the
    course whose code its own name contains, else the name of its parent course does.
    """
    from ledgerloom.operators.upkeep import match_course

    sec = exploded(sections, "struct<id: string, course: string, name: string>").withColumnsRenamed({"id": "section", "course": "parent"})
    par = exploded(courses, "struct<id: string, name: string>").withColumnsRenamed({"id": "parent", "name": "parent_name"})
    codes = wanted.selectExpr("course AS code")
    own = match_course(sec.selectExpr("section AS id", f"{flat_code('name')} AS text"), codes).selectExpr("id AS section", "course AS own")
    via = match_course(par.selectExpr("parent AS id", f"{flat_code('parent_name')} AS text"), codes).selectExpr("id AS parent", "course AS via")
    mapped = sec.join(own, "section", "left").join(via, "parent", "left").selectExpr(
        "section", "if(own <> 'OTHER', own, via) AS course"
    ).where("coalesce(course, 'OTHER') <> 'OTHER'")
    rows = exploded(assignments, "struct<id: string, section: string, name: string, title: string, dueDate: string, endDate: string>")
    rows = rows.join(mapped, "section").selectExpr(
        "*", f"{utc_to_local('''coalesce(nullif(dueDate, ''), endDate)''')} AS due", "trim(coalesce(nullif(name, ''), title)) AS title0"
    )
    return rows.where("title0 <> '' AND due IS NOT NULL").where(window("cast(due AS date)", today, cap)).selectExpr(
        "course", f"{ensure_where('title0', 'on Connect')} AS title", "cast(due AS date) AS date", "date_format(due, 'HH:mm') AS start_time",
        f"{classify_connector('title0')} AS kind", "coalesce(id, '') AS external_id",
    )


def embedded_summaries(pages: DataFrame) -> DataFrame:
    """Daily homework summaries a page carries as JSON in one of its attributes. pages (course, html)."""
    attribute = "regexp_extract(html, 'data-assignment-summaries=\"([^\"]*)\"', 1)"
    plain = pages.select("course", X.unescape_entities(F.expr(attribute)).alias("payload"))
    rows = exploded(plain, "struct<due_date: string, assignment_count: int, estimated_time: string, detail_url: string>", "course")
    return rows.where("due_date <> '' AND assignment_count <> 0").selectExpr(
        "course",
        "concat('Supersite: ', assignment_count, ' activities', if(coalesce(estimated_time, '') = '', '', concat(', est ', estimated_time))) AS title",
        "due_date AS date", f"'{VHL_DUE}' AS start_time", "concat('vhl-', due_date) AS external_id", "coalesce(detail_url, '') AS url",
    )


def _topics_of(payload: str | None) -> Iterator[tuple]:
    """(path, Title, Url, TypeIdentifier, Identifier) of every topic of one content tree, of any depth."""
    try:
        tree = json.loads(payload or "null")
    except ValueError:
        return
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    modules = lambda node: node.get("Modules") if isinstance(node, dict) and isinstance(node.get("Modules"), list) else []
    open_modules = [((), m) for m in reversed(modules(tree))]
    while open_modules:
        path, module = open_modules.pop()
        if not isinstance(module, dict):
            continue
        path = (*path, text(module.get("Title")) or "")
        for topic in module.get("Topics") or ():
            if isinstance(topic, dict):
                yield path, *(text(topic.get(k)) for k in ("Title", "Url", "TypeIdentifier", "Identifier"))
        open_modules.extend((path, m) for m in reversed(modules(module)))


def content_topics(raw: DataFrame, kind: str = "File") -> DataFrame:
    """Topics of one kind in a content tree with the path of modules above them. raw (course, payload).

    A tree has no fixed depth, so it is walked in an Arrow function, one pass over each payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (course, list(path), *topic)
                for course, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for path, *topic in _topics_of(payload)
                if topic[2] == kind
            ]
            columns = list(zip(*rows)) or [()] * len(TOPIC_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TOPIC_ARROW)], schema=TOPIC_ARROW)

    topics = raw.select(F.col("course").cast("string"), "payload").mapInArrow(
        run, "course string, path array<string>, Title string, Url string, TypeIdentifier string, Identifier string"
    )
    name = X.safe_filename("coalesce(Url, '')")
    rows = topics.selectExpr(
        "course", "Identifier AS topic_id", "trim(coalesce(Title, '')) AS title", "coalesce(Url, '') AS url",
        f"{name} AS filename", "array_join(filter(path, p -> p <> ''), ' > ') AS module_path",
    )
    return rows.where("filename <> ''") if kind == "File" else rows


def announcements(raw: DataFrame) -> DataFrame:
    """Published, visible announcements. raw (course, payload)."""
    rows = exploded(
        raw, "struct<Id: bigint, Title: string, IsPublished: boolean, IsHidden: boolean, StartDate: string, CreatedDate: string, Body: struct<Text: string>>", "course"
    )
    return rows.where("NOT coalesce(IsHidden, false) AND coalesce(IsPublished, true)").selectExpr(
        "course", "concat('oaks-', Id) AS id", "trim(coalesce(Title, '')) AS title",
        "left(coalesce(nullif(StartDate, ''), CreatedDate, ''), 10) AS date", f"{X.strip('''coalesce(Body.Text, '')''')} AS text",
    )


def gradebook(objects: DataFrame, values: DataFrame) -> DataFrame:
    """Gradebook items with the learner's values. Both inputs (course, payload); hidden and summed items drop out."""
    shape = (
        "struct<Id: string, Name: string, MaxPoints: double, Weight: double, IsBonus: boolean, IsHidden: boolean,"
        " ExcludeFromFinalGradeCalculation: boolean, GradeObjectType: int>"
    )
    graded = (
        "struct<GradeObjectIdentifier: string, PointsNumerator: double, PointsDenominator: double, DisplayedGrade: string,"
        " WeightedNumerator: double, WeightedDenominator: double>"
    )
    types = ", ".join(map(str, AGGREGATE_TYPES))
    items = exploded(objects, shape, "course").where(f"NOT coalesce(IsHidden, false) AND NOT coalesce(GradeObjectType IN ({types}), false)")
    have = exploded(values, graded, "course").where("GradeObjectIdentifier IS NOT NULL").withColumnRenamed("GradeObjectIdentifier", "Id")
    return items.join(have, ["course", "Id"], "left").selectExpr(
        "course", "Id AS item_id", "trim(coalesce(Name, '')) AS name", "MaxPoints AS max_points", "Weight AS weight",
        "coalesce(IsBonus, false) AS bonus", "coalesce(ExcludeFromFinalGradeCalculation, false) AS excluded",
        "PointsNumerator IS NOT NULL AS graded", "PointsNumerator AS score", "coalesce(PointsDenominator, MaxPoints) AS out_of",
        "coalesce(DisplayedGrade, '') AS displayed", "WeightedNumerator AS weighted_num", "WeightedDenominator AS weighted_den",
    )


def quiz_bodies(raw: DataFrame) -> DataFrame:
    """Text an instructor wrote on a quiz, with due date and attempts. raw (course, payload)."""
    block = "struct<Text: string, Html: string>"
    shape = (
        "struct<QuizId: string, Name: string, DueDate: string, EndDate: string, AttemptsAllowed: struct<IsUnlimited: boolean,"
        f" NumberOfAttemptsAllowed: int>, Description: {block}, Instructions: {block}, Header: {block}, Footer: {block}>"
    )

    def rich(field: str) -> str:
        # The text sits either directly in the block or one level deeper, as an object.
        return X.strip(f"if(startswith({field}.Text, '{{'), coalesce(get_json_object({field}.Text, '$.Text'), ''), coalesce({field}.Text, ''))")

    n = "AttemptsAllowed.NumberOfAttemptsAllowed"
    due = utc_to_local("coalesce(nullif(DueDate, ''), EndDate)")
    body = ", ".join(f"nullif({rich(f)}, '')" for f in ("Description", "Instructions", "Header", "Footer"))
    return exploded(raw, shape, "course").where("trim(Name) <> ''").selectExpr(
        "course", "concat('oaks-quiz-', coalesce(QuizId, '')) AS id", "trim(Name) AS name",
        f"coalesce(date_format({due}, 'yyyy-MM-dd HH:mm'), '') AS due",
        f"CASE WHEN AttemptsAllowed.IsUnlimited THEN 'unlimited attempts' WHEN coalesce({n}, 0) <> 0 THEN concat({n}, if({n} = 1, ' attempt', ' attempts')) ELSE '' END AS attempts",
        f"concat_ws('\\n\\n', {body}) AS body",
    )


def completion_log(lines: DataFrame) -> DataFrame:
    """Append-only completion log; torn or foreign lines are skipped. lines (line_no, text)."""
    shape = "course string, key string, date string, title string, done boolean, at string"
    return lines.select("line_no", F.expr(f"from_json(text, '{shape}') AS r")).select("line_no", "r.*").where(
        "course IS NOT NULL AND key IS NOT NULL AND date IS NOT NULL"
    ).selectExpr(
        "line_no", "upper(course) AS course", "key", "left(date, 10) AS date", "coalesce(title, '') AS title", "coalesce(done, true) AS done", "coalesce(at, '') AS at"
    )


# ------------------------------------------------------------------ all sites at once

ITEM_COLUMNS = {
    "course": "string", "title": "string", "date": "date", "start_time": "string", "end_time": "string", "all_day": "boolean", "kind": "string", "external_id": "string",
}
Connector = Callable[[Mapping[str, DataFrame], str, str | None], DataFrame]

# How the items of a site are read from its payload tables, by name. A caller adds its own sites here.
CONNECTORS: dict[str, Connector] = {
    "oaks_events": lambda t, today, cap: calendar_events(t["payloads"], today, cap),
    "oaks_quizzes": lambda t, today, cap: quizzes(t["payloads"], today, cap),
    "oaks_dropbox": lambda t, today, cap: dropboxes(t["payloads"], today, cap),
    "connect": lambda t, today, cap: publisher_assignments(t["sections"], t["courses"], t["payloads"], t["wanted"], today, cap),
    "vhl": lambda t, today, cap: embedded_summaries(t["pages"]).withColumns({"date": F.expr("try_cast(date AS date)"), "kind": F.lit("quiz")}),
}


def pull(inputs: Mapping[str, Mapping[str, DataFrame]], today: str, cap: str | None = None) -> DataFrame:
    """Items of all sites in ``inputs`` (site -> its payload tables) with one set of columns."""
    found = None
    for site, tables in inputs.items():
        items = CONNECTORS[site](tables, today, cap)
        blank = {"all_day": F.lit(False), "end_time": F.lit("")}
        columns = [(F.col(c) if c in items.columns else blank[c]).cast(t).alias(c) for c, t in ITEM_COLUMNS.items()]
        rows = items.select(F.lit(site).alias("site"), *columns)
        found = rows if found is None else found.unionByName(rows)
    return found
