"""Query keys of the scalar text, title, venue and link functions."""

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions import titles as H
from ledgerloom.functions import venues as V
from ledgerloom.functions.dates import clock, utc_to_local
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import DEADLINES, MESSAGES, TITLES, with_
from ledgerloom.sources.tables import CLOCKS, DAY_SPECS, deadlines, messages, sql_list, titles, venues

WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ASCII_ONLY = "regexp_replace({0}, '[^\\x00-\\x7f]', 'x', 'g')"
T = with_(TITLES)


def duck_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


@query("token_estimate", "SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents")
def token_estimate(t):
    return t.documents.selectExpr("doc_id", f"{X.token_estimate('text')} AS tokens")


SENTENCES = f"""sentence_rows AS (SELECT doc_id, s.i AS pos, {duck_strip("s.x")} AS sentence FROM (
  SELECT doc_id, unnest(list_transform(string_split(
    regexp_replace(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), '\\n{{2,}}', chr(1), 'g'), chr(1)),
    lambda x, i: {{'x': x, 'i': i}})) AS s FROM documents) WHERE {duck_strip("s.x")} <> '')"""


@query(
    "sentences",
    with_(SENTENCES) + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, sentence FROM sentence_rows",
)
def sentences(t):
    return t.documents.select("doc_id", F.expr(f"posexplode_outer({X.sentences('text')}) AS (pos, sentence)")).where("pos IS NOT NULL")


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def content_hash(t):
    return t.documents.selectExpr("doc_id", f"{X.short_hash('text')} AS content_hash")


@query(
    "event_ids",
    with_(DEADLINES)
    + "SELECT id, substr(sha1(source || '|' || course || '|' || title || '|' || strftime(starts_at, '%Y-%m-%dT%H:%M:%S')), 1, 16) AS event_id FROM deadlines",
)
def event_ids(t):
    return deadlines(t.events).selectExpr("id", f"{X.event_id('source', 'course', 'title', 'starts_at')} AS event_id")


def rx(words: str, column: str = "title") -> str:
    return f"regexp_matches({column}, '(?i)\\b({words})\\b')"


KIND_SQL = f"""CASE WHEN {rx('exam|final|midterm|examen')} THEN 'exam' WHEN {rx('quiz|prueba|test')} THEN 'quiz'
WHEN {rx('project|paper|presentation|proyecto|assignment|essay|homework|hw|problem\\s+set|pset|lab|report|reading|discussion|tarea|deberes')}
THEN 'project' ELSE 'admin' END"""
SITE_KIND_SQL = f"""CASE WHEN {rx('office hours?|review session|orientation|drop.?in|zoom link|no class|sample questions?|gu[ií]a de estudio|study guide')}
THEN 'admin' WHEN regexp_matches(title, '(?i)^\\s*week\\s*\\d') THEN 'admin'
WHEN {rx('project|paper|presentation|proyecto|talk abroad')} THEN 'project' WHEN {rx('exam|examen|final|midterm')} THEN 'exam'
WHEN {rx('quiz|prueba|test')} THEN 'quiz' WHEN {rx('syllabus|lecture')} THEN 'admin' ELSE 'quiz' END"""


@query("classify_kind", T + f"SELECT id, title, {KIND_SQL} AS kind FROM titles")
def classify_kind(t):
    return titles(t.part).selectExpr("id", "title", f"{H.classify_kind('title')} AS kind")


@query("classify_connector", T + f"SELECT id, title, {SITE_KIND_SQL} AS kind FROM titles")
def classify_connector(t):
    return titles(t.part).selectExpr("id", "title", f"{H.classify_connector('title')} AS kind")


GRADED_SQL = rx(
    "quiz|prueba|test|exam|examen|final|midterm|project|proyecto|paper|essay|presentation|assignment|homework|hw|tarea|deberes|"
    "problem\\s+set|pset|lab|report|draft|discussion|submission|dropbox|activities"
)


@query("looks_graded", T + f"SELECT id, kind IN ('exam', 'project') OR (kind = 'quiz' AND {GRADED_SQL}) AS graded FROM (SELECT *, {SITE_KIND_SQL} AS kind FROM titles)")
def looks_graded(t):
    rows = titles(t.part).selectExpr("id", "title", f"{H.classify_connector('title')} AS kind")
    return rows.selectExpr("id", f"{H.looks_graded('title', 'kind')} AS graded")


BARE = r"replace(regexp_replace(lower(title), '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '&', ' and ')"
KEY_STOP = "'the','a','an','of','for','and','in','on','due','class','en','de','la','el','los','las','before','no','real','date','target'"
TITLE_PARTS = f"""title_parts AS (SELECT *, list_filter(w0, lambda x, i: list_position(w0, x) = i) AS words FROM (
  SELECT *, list_filter(regexp_extract_all({BARE}, '[a-z0-9]+'), lambda w: NOT regexp_full_match(w, '\\d+') AND NOT list_contains([{KEY_STOP}], w)) AS w0,
    array_to_string(regexp_extract_all({BARE}, '\\b(\\d+)\\b', 1), '-') AS nums FROM {{src}}))"""
KEY = "upper(course) || '|' || array_to_string(words[1:3], ' ') || '|' || nums"


@query("title_key", with_(TITLES, TITLE_PARTS.format(src="titles")) + f"SELECT id, {KEY} AS key FROM title_parts")
def title_key(t):
    return titles(t.part).selectExpr("id", f"{H.title_key('course', 'title')} AS key")


@query(
    "ensure_where",
    T + f"""SELECT id, CASE WHEN {rx('oaks|d2l|brightspace|connect|smartbook|vhl|supersite|blended|in.?class|en clase|in person|mct|my conversation trainer|talk abroad|zoom|lockdown|respondus|dropbox')}
THEN title ELSE title || ' (on Connect)' END AS title FROM titles""",
)
def ensure_where(t):
    return titles(t.part).selectExpr("id", f"{H.ensure_where('title', 'on Connect')} AS title")


@query(
    "utc_to_local",
    """SELECT event_id, strftime(l, '%Y-%m-%d') AS date, strftime(l, '%H:%M') AS time
FROM (SELECT event_id, ts - CASE event_id % 3 WHEN 2 THEN INTERVAL 450 MINUTE ELSE INTERVAL 300 MINUTE END AS l FROM events)""",
)
def utc_to_local_q(t):
    """January is winter time, five hours behind; every third row is written with a +02:30 offset."""
    raw = (
        "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '' ELSE '+02:30' END)"
    )
    rows = t.events.selectExpr("event_id", f"{raw} AS raw").selectExpr("event_id", f"{utc_to_local('raw')} AS l")
    return rows.selectExpr("event_id", "date_format(l, 'yyyy-MM-dd') AS date", f"{clock('l')} AS time")


VENUES = f"""venues AS (SELECT s_suppkey AS id, s_name AS name, ([{sql_list(DAY_SPECS)}])[s_suppkey % {len(DAY_SPECS)} + 1] AS spec,
  ([{sql_list(CLOCKS)}])[s_suppkey % {len(CLOCKS)} + 1] AS st, ([{sql_list(CLOCKS)}])[(s_suppkey + 2 + s_nationkey) % {len(CLOCKS)} + 1] AS et FROM supplier),
parsed AS (SELECT *, CASE spec WHEN 'Tue-Fri' THEN '1,2,3,4' WHEN 'Mon, Wed, Fri' THEN '0,2,4' WHEN 'daily' THEN '0,1,2,3,4,5,6'
    WHEN 'Fri-Sun' THEN '4,5,6' WHEN 'Sun-Thu' THEN '0,1,2,3,6' WHEN 'Sat & Sun' THEN '5,6' WHEN 'Wednesday and Thursday' THEN '2,3'
    WHEN 'Mon-Tue, Thu' THEN '0,1,3' ELSE '' END AS days,
  CASE spec WHEN 'Tue-Fri' THEN 'Tue-Fri' WHEN 'Mon, Wed, Fri' THEN 'Mon, Wed, Fri' WHEN 'daily' THEN 'Daily' WHEN 'Fri-Sun' THEN 'Fri-Sun'
    WHEN 'Sun-Thu' THEN 'Mon-Thu, Sun' WHEN 'Sat & Sun' THEN 'Sat-Sun' WHEN 'Wednesday and Thursday' THEN 'Wed-Thu'
    WHEN 'Mon-Tue, Thu' THEN 'Mon-Tue, Thu' ELSE 'days not confirmed' END AS label,
  CASE st WHEN '16:00' THEN 960 WHEN '4pm' THEN 960 WHEN '5:30 PM' THEN 1050 WHEN '11am' THEN 660 WHEN '17:15' THEN 1035 END AS s,
  CASE et WHEN '16:00' THEN 960 WHEN '4pm' THEN 960 WHEN '5:30 PM' THEN 1050 WHEN '11am' THEN 660 WHEN '17:15' THEN 1035 END AS e FROM venues)"""


def parsed_venues(t):
    return venues(t.supplier).selectExpr(
        "id", "name", f"{V.parse_days('days_spec')} AS days", f"{V.clock_minute('start_text')} AS s", f"{V.clock_minute('end_text')} AS e"
    )


@query("parse_days", with_(VENUES) + "SELECT id, days FROM parsed")
def parse_days(t):
    return parsed_venues(t).selectExpr("id", "array_join(days, ',') AS days")


@query("format_days", with_(VENUES) + "SELECT id, label FROM parsed")
def format_days(t):
    return parsed_venues(t).selectExpr("id", f"{V.format_days('days')} AS label")


CLOCK_SQL = "CASE {0} WHEN 960 THEN '4:00 PM' WHEN 1050 THEN '5:30 PM' WHEN 660 THEN '11:00 AM' ELSE '5:15 PM' END"


@query(
    "parse_clock",
    with_(VENUES) + f"""SELECT id, s AS start_min, e AS end_min, CASE WHEN s IS NULL THEN 'time not confirmed'
WHEN e IS NULL THEN 'from ' || {CLOCK_SQL.format('s')} ELSE {CLOCK_SQL.format('s')} || ' - ' || {CLOCK_SQL.format('e')} END AS opening FROM parsed""",
)
def parse_clock(t):
    return parsed_venues(t).selectExpr("id", "s AS start_min", "e AS end_min", f"{V.window_text('s', 'e')} AS opening")


@query(
    "venue_state",
    with_(VENUES) + """SELECT id, CASE WHEN s IS NULL THEN 'upcoming' WHEN 975 >= s AND 975 < coalesce(e, 1380) THEN 'live'
WHEN 975 < s AND s - 975 <= 60 THEN 'soon' WHEN e IS NOT NULL AND 975 >= e THEN 'done' ELSE 'upcoming' END AS state FROM parsed""",
)
def venue_state(t):
    return parsed_venues(t).selectExpr("id", f"{V.venue_state('s', 'e', 975)} AS state")


@query("venues_today", with_(VENUES) + "SELECT id, name FROM parsed WHERE s IS NOT NULL AND contains(days, '4')")
def venues_today(t):
    """Confirmed venues open on a Friday."""
    return parsed_venues(t).where("size(days) > 0 AND s IS NOT NULL AND array_contains(days, weekday(date'2024-01-19'))").select("id", "name")


@query("short_source", "SELECT page_id, array_to_string(list_slice(p, greatest(len(p) - 1, 1), len(p)), '/') AS short FROM (SELECT page_id, string_split(rtrim(replace(url, '\\', '/'), '/'), '/') AS p FROM pages)")
def short_source(t):
    return t.pages.selectExpr("page_id", f"{X.short_source('url')} AS short")


LINK_TITLES = "CASE page_id % 3 WHEN 0 THEN 'Syllabus.docx' WHEN 1 THEN 'Week 1: notes/slides?' ELSE 'Page ' || page_id END"


def link_rows(t):
    """One link per page; urls vary in form by page number, titles carry awkward characters."""
    url = (
        "CASE page_id % 9 WHEN 0 THEN concat('https://docs.google.com/document/d/D', page_id, '_x/edit')"
        " WHEN 1 THEN concat('https://docs.google.com/presentation/d/P-', page_id)"
        " WHEN 2 THEN concat('https://docs.google.com/spreadsheets/d/S', page_id, '/edit#gid=0')"
        " WHEN 3 THEN concat('https://school.sharepoint.com/:w:/s/x', page_id, '?e=1')"
        " WHEN 4 THEN concat('https://www.youtube.com/watch?v=', page_id)"
        " WHEN 5 THEN concat('https://nam.safelinks.protection.outlook.com/?url=', url_encode(url), '&data=1')"
        " WHEN 6 THEN concat('/d2l/le/content/', page_id) WHEN 7 THEN concat('https://school.sharepoint.com/sites/', page_id) ELSE url END"
    )
    title = "CASE page_id % 3 WHEN 0 THEN 'Syllabus.docx' WHEN 1 THEN 'Week 1: notes/slides?' ELSE concat('Page ', page_id) END"
    raw = t.pages.selectExpr("page_id", f"{title} AS title", f"{url} AS raw_url")
    links = raw.selectExpr("page_id", "title", f"{X.unwrap_safelink('trim(raw_url)')} AS url").selectExpr("*", f"{X.link_kind('url')} AS kind")
    return links.selectExpr("*", f"{X.link_session('url', 'kind')} AS session", f"{X.link_extension('url', 'kind')} AS ext").selectExpr(
        "page_id", "title", "kind", "session", "ext", f"{X.link_url('url')} AS url",
        f"{X.fetch_url(X.link_url('url'), 'kind')} AS fetch_url", f"{X.dest_name('title', 'kind', 'ext')} AS dest",
    )


LINKS = f"""links0 AS (SELECT page_id, page_id % 9 AS f, {LINK_TITLES} AS title, CASE WHEN page_id % 9 = 6 THEN 'https://lms.cofc.edu/d2l/le/content/' || page_id
    WHEN page_id % 9 = 0 THEN 'https://docs.google.com/document/d/D' || page_id || '_x/edit'
    WHEN page_id % 9 = 1 THEN 'https://docs.google.com/presentation/d/P-' || page_id
    WHEN page_id % 9 = 2 THEN 'https://docs.google.com/spreadsheets/d/S' || page_id || '/edit#gid=0'
    WHEN page_id % 9 = 3 THEN 'https://school.sharepoint.com/:w:/s/x' || page_id || '?e=1'
    WHEN page_id % 9 = 4 THEN 'https://www.youtube.com/watch?v=' || page_id
    WHEN page_id % 9 = 7 THEN 'https://school.sharepoint.com/sites/' || page_id ELSE url END AS url FROM pages),
links1 AS (SELECT *, CASE f WHEN 0 THEN 'google_doc' WHEN 1 THEN 'google_slides' WHEN 2 THEN 'google_sheet' WHEN 3 THEN 'sharepoint'
    WHEN 7 THEN 'sharepoint' WHEN 4 THEN 'reference' ELSE 'web' END AS kind,
    CASE WHEN f IN (0, 1, 2) THEN 'google' WHEN f IN (3, 7) THEN 'sharepoint' WHEN f = 6 THEN 'oaks' ELSE '' END AS session,
    CASE f WHEN 0 THEN 'txt' WHEN 1 THEN 'txt' WHEN 2 THEN 'csv' WHEN 3 THEN 'docx' WHEN 7 THEN 'bin' ELSE '' END AS ext,
    CASE page_id % 3 WHEN 0 THEN 'Syllabus.docx' WHEN 1 THEN 'Week 1_ notes_slides_' ELSE 'Page ' || page_id END AS safe FROM links0),
links AS (SELECT page_id, title, kind, session, ext, url, CASE f WHEN 0 THEN 'https://docs.google.com/document/d/D' || page_id || '_x/export?format=txt'
    WHEN 1 THEN 'https://docs.google.com/presentation/d/P-' || page_id || '/export/txt'
    WHEN 2 THEN 'https://docs.google.com/spreadsheets/d/S' || page_id || '/export?format=csv'
    WHEN 3 THEN url || '&download=1' WHEN 7 THEN url || '?download=1' ELSE url END AS fetch_url,
    CASE WHEN ext = '' THEN safe || '.md' WHEN safe LIKE '%.' || ext THEN safe ELSE safe || '.' || ext END AS dest FROM links1)"""


@query("classify_links", with_(LINKS) + "SELECT * FROM links")
def classify_links(t):
    return link_rows(t)


@query(
    "label_url",
    """WITH u AS (SELECT page_id, split_part(split_part(split_part(url, '?', 1), '#', 1), '://', 1) AS scheme, split_part(split_part(split_part(url, '?', 1), '#', 1), '://', 2) || CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END AS rest FROM pages)
SELECT page_id, CASE WHEN page_id % 11 = 7 THEN '<feed url hidden>' ELSE scheme || '://' || split_part(rest, '/', 1) || '/...' || CASE WHEN rest LIKE '%/' OR rest NOT LIKE '%/%' THEN '' ELSE '/' || split_part(rest, '/', -1) END END AS label FROM u""",
)
def label_url(t):
    """Some addresses end in a slash, some have a broken host."""
    bare = "regexp_extract(url, '^[^?#]*', 0)"
    urls = t.pages.selectExpr("page_id", f"CASE WHEN page_id % 11 = 7 THEN 'https://[::1/a/b.ics' WHEN page_id % 3 = 0 THEN concat({bare}, '/?q=1') ELSE url END AS url")
    return urls.selectExpr("page_id", f"{X.label_url('url')} AS label")


@query(
    "scrub_text",
    """SELECT page_id, 'HTTPError for ''<feed url hidden>'' token <hidden>' AS message, 'present, ' || length(md5(url)) || ' chars' AS secret FROM pages""",
)
def scrub_text(t):
    """An error message that echoes a feed url in full and its token alone."""
    rows = t.pages.selectExpr("page_id", "md5(url) AS token").selectExpr(
        "page_id", "token", "concat('https://cal.example.org/ical/', token, '/basic.ics') AS feed"
    ).selectExpr("*", "concat('HTTPError for \\'', feed, '\\' token ', token) AS message")
    return rows.selectExpr("page_id", f"{X.scrub('message', 'feed')} AS message", f"{X.redact('token')} AS secret")


@query(
    "estimate_minutes",
    T + r"""SELECT id, CASE WHEN title LIKE '%est 1h 10m%' THEN 70 WHEN title LIKE '%(25m)%' THEN 25 END AS minutes,
coalesce(nullif(trim(regexp_replace(title, '\s*\[[^\]]*\]\s*$', '')), ''), title) AS short_title FROM titles""",
)
def estimate_minutes(t):
    return titles(t.part).selectExpr("id", f"{H.estimate_minutes('title')} AS minutes", f"{H.strip_aside('title')} AS short_title")


@query(
    "slugify",
    r"""SELECT p_partkey, coalesce(nullif(regexp_replace(substr(lower(regexp_replace(regexp_replace(p_name || ' (' || p_type || ') — ' || p_brand || ' ' || p_name, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 32), '-+$', ''), ''), 'announcement') AS slug FROM part""",
)
def slugify(t):
    return t.part.selectExpr("p_partkey", "concat(p_name, ' (', p_type, ') — ', p_brand, ' ', p_name) AS x").selectExpr(
        "p_partkey", f"{H.slugify('x', 32)} AS slug"
    )


FOLD = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), 'ß', ' '),"
    r" '\([^)]*\)', ' ', 'g'), '\[[^\]]*\]', ' ', 'g'), '\b[0-9]{1,2}:[0-9]{2}\s*(?:am|pm)?\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
)
RUN_STOP = "'de','en','la','el','y','del','due','the','of','and','a','in','on','at','por','para','con'"


@query(
    "fold_words",
    f"""SELECT doc_id, array_to_string(list_filter(string_split({FOLD}, ' '), lambda w: w <> '' AND NOT list_contains([{RUN_STOP}], w)
AND (length(w) > 1 OR regexp_matches(w, '[0-9]'))), ' ') AS words FROM documents""",
)
def fold_words(t):
    return t.documents.selectExpr("doc_id", f"array_join({H.run_words('text')}, ' ') AS words")


@query(
    "code_lookup",
    "SELECT event_id, CASE k " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in X.WEATHER.items())
    + " ELSE 'Code ' || k END AS sky FROM (SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events)",
)
def code_lookup(t):
    return t.events.selectExpr("event_id", "cast(get_json_object(props, '$.k') AS int) AS k").selectExpr(
        "event_id", f"{X.weather_text('k')} AS sky"
    )


INTENT_SCHEDULE = (
    "due|deadline|deadlines|tomorrow|tmr|tonight|today|this week|next week|upcoming|when (is|are|do|does)|what(''| i)?s (due|next|coming)|"
    "schedule|calendar|turn(ing)? in|submit(ted)? by|exam (on|date|week)|quiz (on|date|week)|busy week|workload"
)
INTENT_GRADES = (
    "grade[sd]?|gradebook|gpa|how am i doing|what (do|would|will) i need|need (on|for) the (final|exam|midterm)|"
    "my (current )?(average|scores?|points|standing|percent(age)?)|current (average|standing)|am i passing|pass(ing)? the (class|course)"
)
ASKED = "CASE turn % 4 WHEN 0 THEN ' What''s due this week?' WHEN 2 THEN ' What do I need on the final?' ELSE '' END"


@query(
    "question_intent",
    with_(MESSAGES) + f"""SELECT conversation_id, turn, {rx(INTENT_SCHEDULE, 'c')} AS schedule, {rx(INTENT_GRADES, 'c')} AS grades
FROM (SELECT *, regexp_replace(content || {ASKED}, '[^\\x00-\\x7f]', 'x', 'g') AS c FROM messages)""",
)
def question_intent(t):
    asked = "CASE turn % 4 WHEN 0 THEN \" What's due this week?\" WHEN 2 THEN ' What do I need on the final?' ELSE '' END"
    rows = messages(t.conversations).selectExpr("conversation_id", "turn", f"concat(content, {asked}) AS c")
    return rows.selectExpr("conversation_id", "turn", f"{X.asks_schedule('c')} AS schedule", f"{X.asks_grades('c')} AS grades")


# Entities that occur in the pages; the Spark side knows all of them.
UNESCAPED = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
NO_BLOCKS = "html"
for _tag in ("script", "style", "nav", "header", "footer"):
    NO_BLOCKS = f"regexp_replace({NO_BLOCKS}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
HTML_SQL = f"""SELECT page_id, {duck_strip(f"regexp_replace(regexp_replace({UNESCAPED.format(f'''regexp_replace({NO_BLOCKS}, '(?s)<[^>]+>', ' ', 'g')''')}, '[ \\t]+', ' ', 'g'), '\\n{WS}*\\n{WS}*\\n+', chr(10) || chr(10), 'g')")} AS text FROM pages"""


@query("html_text", HTML_SQL)
def html_text(t):
    return t.pages.select("page_id", X.html_text("html").alias("text"))


def fenced_messages(t):
    """Messages wrapped in fences: one svg block, a nested html block, two blocks, an unclosed block."""
    return messages(t.conversations).selectExpr(
        "conversation_id",
        "turn",
        "CASE turn % 4 WHEN 0 THEN concat('See\\n```svg\\n', content, '\\n```\\ndone')"
        " WHEN 1 THEN concat('````md\\n```html\\n', content, '\\n```\\n````')"
        " WHEN 2 THEN concat('~~~html\\n', content, '\\n~~~\\n\\n```svg\\n<svg/>\\n```')"
        " ELSE concat('```html\\n', content) END AS content",
    )


@query(
    "vis_blocks",
    with_(MESSAGES) + """SELECT conversation_id, turn, 0 AS pos, 'svg' AS lang, content AS src FROM messages WHERE turn % 4 = 0
UNION ALL SELECT conversation_id, turn, 0, 'html', content FROM messages WHERE turn % 4 = 2
UNION ALL SELECT conversation_id, turn, 1, 'svg', '<svg/>' FROM messages WHERE turn % 4 = 2""",
)
def vis_blocks(t):
    return fenced_messages(t).select(
        "conversation_id", "turn", F.expr(f"posexplode({X.fenced_blocks('content')}) AS (pos, b)")
    ).select("conversation_id", "turn", "pos", "b.lang", "b.src")


@query("login_pages", """SELECT page_id FROM pages WHERE (contains(lower(substr(html, 1, 2000)), '<html') OR contains(lower(substr(html, 1, 2000)), '<!doctype html'))
AND (contains(lower(substr(html, 1, 2000)), 'sign in') OR contains(lower(substr(html, 1, 2000)), 'password') OR contains(lower(substr(html, 1, 2000)), 'log in')
  OR contains(lower(substr(html, 1, 2000)), 'accounts.google') OR contains(lower(substr(html, 1, 2000)), 'login.microsoftonline')
  OR page_id % 5 = 0)""")
def login_pages(t):
    """Pages whose head asks to sign in; every fifth page gets such a title put in front."""
    body = "if(page_id % 5 = 0, concat('<html><title>Please Sign In</title>', html), html)"
    return t.pages.selectExpr("page_id", f"{body} AS body").where(X.is_login_page("body")).select("page_id")
