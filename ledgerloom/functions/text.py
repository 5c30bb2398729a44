"""Text, path, link and log expressions. Each returns SQL text for ``F.expr`` unless noted."""

from __future__ import annotations

import html as html_entities

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions import patterns as P
from ledgerloom.functions.patterns import word_match
from ledgerloom.functions.slices import mapped


def token_estimate(text: str) -> str:
    """A quarter of the characters, at least 1."""
    return f"greatest(1, cast(char_length({text}) div 4 AS int))"


def strip(text: str) -> str:
    """Trim every kind of white space."""
    return f"regexp_replace({text}, '(?U)^\\\\s+|\\\\s+$', '')"


def sentences(text: str) -> str:
    """Sentence-like units: split after . ! ? and at blank lines, blanks dropped."""
    pieces = f"split({text}, '(?U)(?<=[.!?])\\\\s+|\\\\n{{2,}}')"
    return f"filter(transform({pieces}, s -> {strip('s')}), s -> s <> '')"


def short_hash(text: str) -> str:
    return f"substring(sha2({text}, 256), 1, 16)"


def link_id(url: str) -> str:
    return f"substring(sha1({url}), 1, 16)"


def event_id(source: str, course: str, title: str, starts_at: str) -> str:
    from ledgerloom.functions.dates import iso_text

    return f"substring(sha1(concat({source}, '|', {course}, '|', {title}, '|', {iso_text(starts_at)})), 1, 16)"


def short_source(path: str) -> str:
    """The last two parts of a path."""
    parts = f"split(regexp_replace(replace({path}, '\\\\', '/'), '/+$', ''), '/')"
    return f"array_join(slice({parts}, greatest(size({parts}) - 1, 1), 2), '/')"


def extension(path: str) -> str:
    return f"if(contains({path}, '.'), lower(substring_index({path}, '.', -1)), '(none)')"


def asks_schedule(text: str) -> str:
    return word_match(text, P.SCHEDULE_WORDS)


def asks_grades(text: str) -> str:
    return word_match(text, P.GRADE_INTENT_WORDS)


def percent_count(text: str) -> str:
    """How many percentages a text states."""
    return f"size(regexp_extract_all({text}, '(?U)[0-9]{{1,3}}\\\\s*%', 0))"


# ------------------------------------------------------------------ links

# Fixed value: addresses of shared documents.
GOOGLE_DOC = "docs\\\\.google\\\\.com/(document|presentation|spreadsheets)/d/([A-Za-z0-9_-]+)"
# Hosts that carry no text to index.
REFERENCE_HOSTS = (
    "instagram.com youtube.com youtu.be zoom.us jeopardylabs.com tiktok.com facebook.com twitter.com x.com vimeo.com"
).split()


def unwrap_safelink(url: str) -> str:
    # The wrapped address is escaped once or twice; what cannot be unescaped stays as it is.
    once = f"try_url_decode(try_parse_url({url}, 'QUERY', 'url'))"
    inner = f"coalesce(try_url_decode(replace({once}, '+', '%2B')), {once})"
    return f"if(contains({url}, 'safelinks.protection.outlook.com'), coalesce({inner}, {url}), {url})"


def _host(names: str) -> str:
    """Pattern text: a url whose host holds one of the names."""
    return f"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*({names})"


def _dots(names) -> str:
    return "|".join(n.replace(".", "\\\\.") for n in names)


# The link expressions name their argument as seldom as they can: filters on them inline the whole chain.
def link_kind(url: str) -> str:
    docs = "map('document', 'google_doc', 'presentation', 'google_slides', 'spreadsheets', 'google_sheet')"
    return (
        f"coalesce(try_element_at({docs}, regexp_extract({url}, '{GOOGLE_DOC}', 1)),"
        f" CASE WHEN rlike({url}, '{_host(_dots(['sharepoint.com']))}(?:[:/?#]|$)') THEN 'sharepoint'"
        f" WHEN rlike({url}, '{_host(_dots(REFERENCE_HOSTS))}') THEN 'reference' ELSE 'web' END)"
    )


def link_session(url: str, kind: str) -> str:
    """Which stored session the link needs; '' for none."""
    fixed = "map('google_doc', 'google', 'google_slides', 'google', 'google_sheet', 'google', 'sharepoint', 'sharepoint', 'reference', '')"
    return (
        f"coalesce(try_element_at({fixed}, {kind}),"
        f" CASE WHEN rlike({url}, '^/(d2l|content)/|{_host(_dots(['lms.cofc.edu', 'brightspace.com']))}') THEN 'oaks'"
        f" WHEN rlike({url}, '{_host(_dots(['blended-teaching.com']))}') THEN 'blended' ELSE '' END)"
    )


def link_extension(url: str, kind: str) -> str:
    seg = f"regexp_extract({url}, 'sharepoint\\\\.com/:([wxpb]):/', 1)"
    return (
        f"CASE WHEN {kind} IN ('google_doc', 'google_slides') THEN 'txt' WHEN {kind} = 'google_sheet' THEN 'csv'"
        f" WHEN {kind} = 'sharepoint' THEN CASE {seg} WHEN 'w' THEN 'docx' WHEN 'x' THEN 'xlsx' WHEN 'p' THEN 'pptx'"
        f" WHEN 'b' THEN 'pdf' ELSE 'bin' END ELSE '' END"
    )


def link_url(url: str) -> str:
    """Relative course links get their host back."""
    return f"if({url} LIKE '/d2l/%' OR {url} LIKE '/content/%', concat('https://lms.cofc.edu', {url}), {url})"


def fetch_url(url: str, kind: str) -> str:
    doc = f"regexp_extract({url}, '{GOOGLE_DOC}', 2)"
    base = "https://docs.google.com"
    return (
        f"CASE {kind} WHEN 'google_doc' THEN concat('{base}/document/d/', {doc}, '/export?format=txt')"
        f" WHEN 'google_slides' THEN concat('{base}/presentation/d/', {doc}, '/export/txt')"
        f" WHEN 'google_sheet' THEN concat('{base}/spreadsheets/d/', {doc}, '/export?format=csv')"
        f" WHEN 'sharepoint' THEN concat({url}, if(contains({url}, '?'), '&', '?'), 'download=1') ELSE {url} END"
    )


def dest_name(title: str, kind: str, ext: str) -> str:
    """File name of the saved link; documents keep one extension, pages become notes."""
    safe = f"coalesce(nullif({strip(f'''regexp_replace({title}, '[<>:\"/|?*{chr(92) * 4}]', '_')''')}, ''), 'link')"
    return (
        f"CASE WHEN {kind} LIKE 'google%' OR {kind} = 'sharepoint' THEN"
        f" if(endswith(lower({safe}), concat('.', {ext})), {safe}, concat({safe}, '.', {ext})) ELSE concat({safe}, '.md') END"
    )


def safe_filename(url: str) -> str:
    """Last url part with characters that file systems refuse replaced."""
    last = f"if(contains({url}, '/'), substring_index({url}, '/', -1), '')"
    return strip(f"regexp_replace({last}, '[<>:\"|?*{chr(92) * 4}]', '_')")


# ------------------------------------------------------------------ secrets

# What stands in for a feed address and for its secret parts.
HIDDEN_URL, HIDDEN_PART = "<feed url hidden>", "<hidden>"


def label_url(url: str) -> str:
    """Scheme, host and file name; the middle of the path, where tokens live, is dropped."""
    head = f"regexp_extract({url}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1)"
    path = f"regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1)"
    tail = f"substring_index({path}, '/', -1)"
    net = f"substring_index(substring_index(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^?#]*)', 1), '/', 1), '?', 1)"
    broken = f"contains({net}, '[') <> contains({net}, ']')"
    return (
        f"CASE WHEN {broken} THEN '{HIDDEN_URL}' WHEN {head} = '' THEN {url} WHEN {tail} = '' THEN concat({head}, '/...')"
        f" ELSE concat({head}, '/.../', {tail}) END"
    )


def scrub(text: str, url: str) -> str:
    """Remove a url and its long path parts from a message."""
    parts = f"filter(split({url}, '/'), p -> length(p) >= 16 AND p <> 'calendar.google.com')"
    return f"aggregate({parts}, replace({text}, {url}, '{HIDDEN_URL}'), (s, p) -> replace(s, p, '{HIDDEN_PART}'))"


def redact(value: str, show_prefix: int = 0) -> str:
    """'present, N chars' instead of the value."""
    head = f"if(length({value}) > {show_prefix}, concat(', starts ', substring({value}, 1, {show_prefix})), '')" if show_prefix else "''"
    return (
        f"CASE WHEN {value} IS NULL THEN 'missing' WHEN {value} = '' THEN 'empty'"
        f" ELSE concat('present, ', length({value}), ' chars', {head}) END"
    )


# ------------------------------------------------------------------ html

def without_tags(html: str) -> str:
    """Body text of a page with tags blanked; entities still encoded."""
    # Blocks without body text, and what a tag is.
    no_blocks = f"regexp_replace({html}, '(?is)<(script|style|nav|header|footer)[^>]*>.*?</\\\\1>', ' ')"
    return f"regexp_replace({no_blocks}, '(?s)<[^>]+>', ' ')"


#: All named and numeric entities, by the standard library's table.
unescape_entities = mapped(html_entities.unescape, StringType(), pa.string())


def html_text(html: str) -> Column:
    """Readable text of a web page, white space collapsed."""
    plain = unescape_entities(F.expr(without_tags(html)))
    spaced = F.regexp_replace(plain, "[ \\t]+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, "(?U)\\n\\s*\\n\\s*\\n+", "\n\n"), "(?U)^\\s+|\\s+$", "")


def is_login_page(body: str) -> str:
    """An html body whose head asks to sign in."""
    head = f"lower(substring({body}, 1, 2000))"
    # What a sign-in page says.
    words = ["sign in", "password", "log in", "accounts.google", "login.microsoftonline"]
    asks = " OR ".join(f"contains({head}, '{w}')" for w in words)
    return f"((contains({head}, '<html') OR contains({head}, '<!doctype html')) AND ({asks}))"


def fenced_blocks(text: str, langs: tuple[str, ...] = ("svg", "html")) -> str:
    """Top-level fenced blocks of the given languages as array<struct<lang, src>>.

    A fence closes only on the same mark, at least as long and without a language, so a block shown
    inside a longer fence is text.
    """
    wanted = ", ".join(f"'{x}'" for x in langs)
    fence = "^\\\\s*(`{3,}|~{3,})\\\\s*([A-Za-z0-9_+-]*)\\\\s*$"
    mark, lang = f"regexp_extract(line, '{fence}', 1)", f"regexp_extract(line, '{fence}', 2)"
    state = (
        "named_struct('mark', {m}, 'lang', {l}, 'body', {b}, 'blocks', {k})"
    )
    empty = "cast(array() AS array<string>)"
    start = state.format(m="''", l="''", b=empty, k="cast(array() AS array<struct<lang:string,src:string>>)")
    opened = state.format(m=mark, l=f"if({lang} IN ({wanted}), {lang}, '')", b=empty, k="s.blocks")
    closed = state.format(
        m="''", l="''", b=empty,
        k="if(s.lang = '', s.blocks, array_append(s.blocks, named_struct('lang', s.lang, 'src', array_join(s.body, '\\n'))))",
    )
    kept = state.format(m="s.mark", l="s.lang", b="if(s.lang = '', s.body, array_append(s.body, line))", k="s.blocks")
    closes = f"{mark} <> '' AND {lang} = '' AND substring({mark}, 1, 1) = substring(s.mark, 1, 1) AND length({mark}) >= length(s.mark)"
    return (
        f"aggregate(split({text}, '\\n'), {start}, (s, line) ->"
        f" CASE WHEN s.mark = '' AND {mark} <> '' THEN {opened} WHEN s.mark <> '' AND {closes} THEN {closed} ELSE {kept} END,"
        f" s -> s.blocks)"
    )


# ------------------------------------------------------------------ code lists

# Weather codes and what they mean.
WEATHER = {
    0: "Clear", 1: "Mostly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog", 48: "Rime fog",
    51: "Light drizzle", 53: "Drizzle", 55: "Heavy drizzle", 56: "Freezing drizzle", 57: "Freezing drizzle",
    61: "Light rain", 63: "Rain", 65: "Heavy rain", 66: "Freezing rain", 67: "Freezing rain",
    71: "Light snow", 73: "Snow", 75: "Heavy snow", 77: "Snow grains",
    80: "Light showers", 81: "Showers", 82: "Violent showers", 85: "Snow showers", 86: "Heavy snow showers",
    95: "Thunderstorm", 96: "Thunderstorm, hail", 99: "Thunderstorm, hail",
}


def weather_text(code: str) -> str:
    entries = ", ".join(f"{k}, '{v}'" for k, v in WEATHER.items())
    return f"CASE WHEN {code} IS NULL THEN 'Unknown' ELSE coalesce(try_element_at(map({entries}), {code}), concat('Code ', {code})) END"
