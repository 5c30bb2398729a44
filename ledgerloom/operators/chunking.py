"""Sections of documents and sentence-packed chunks.

Sections and sentences are array expressions over one row, so nothing is shuffled before packing. Packing is
order-dependent; one Arrow function turns the sentence array of a section into its chunk array.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ledgerloom.functions import text as X
from ledgerloom.functions.slices import mapped

TARGET_TOKENS = 800
OVERLAP_TOKENS = 100
ZERO_CHUNKS = "parsed to zero chunks"


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def overlap_for(target: int) -> int:
    """The overlap keeps its share of the target when a model's window shrinks it."""
    return max(1, round(OVERLAP_TOKENS * target / TARGET_TOKENS))


def _word_spans(words: list[str], target: int, count: Callable[[str], int]) -> list[str]:
    """Words joined into as long stretches as fit the target; the longest fit is found by bisection."""
    spans, at = [], 0
    while at < len(words):
        # Costs only grow with more words, so the stretches that fit come before those that do not.
        fit = bisect_right(range(at + 2, len(words) + 1), target, key=lambda end: count(" ".join(words[at:end])))
        spans.append(" ".join(words[at : at + 1 + fit]))
        at += 1 + fit
    return spans


def _char_spans(text: str, target: int, count: Callable[[str], int]) -> list[str]:
    """A text without word breaks, cut where its own characters per token say that the target is reached."""
    edges = [0]
    while len(text) - edges[-1] > 4 and (cost := count(text[edges[-1] :])) > target:
        edges.append(edges[-1] + max(4, (len(text) - edges[-1]) * target // cost))
    return [text[a:b] for a, b in pairwise([*edges, len(text)]) if a < b]


def cut_words(sentence: str, target: int, count: Callable[[str], int]) -> list[str]:
    """Pieces of one oversize sentence: stretches of words, and pieces of words that are too long themselves."""
    spans = _word_spans(sentence.split(), target, count)
    return [piece for span in spans for piece in ([span] if count(span) <= target else _char_spans(span, target, count))]


def pack(sentences, target: int, overlap: int, count: Callable[[str], int]) -> list[str]:
    """Chunks of at most ``target`` tokens; each starts with up to ``overlap`` tokens of the one before.

    With running totals a chunk is a span [start, end): the end is the last sentence that still fits, and the
    next start is the earliest one whose tail fits the overlap and leaves room for the sentence that follows.
    """
    units: list[str] = []
    for s in sentences:
        units += [s] if count(s) <= target else cut_words(s, target, count)
    totals = list(accumulate((count(u) for u in units), initial=0))
    chunks, start, end = [], 0, 0
    while end < len(units):
        end = max(end + 1, bisect_right(totals, totals[start] + target) - 1)
        chunks.append("\n".join(units[start:end]))
        if end < len(units):
            room = max(0, min(overlap, target - (totals[end + 1] - totals[end])))
            tail = bisect_left(totals, totals[end] - room, start, end)
            start = end if tail == start else tail
    return chunks


def packer(target: int = TARGET_TOKENS, overlap: int | None = None, count: Callable[[str], int] = estimate):
    """A column function array<sentence> -> array<chunk>. ``count`` may be a model's tokenizer."""
    carry = OVERLAP_TOKENS if overlap is None and target == TARGET_TOKENS else overlap or overlap_for(target)
    return mapped(lambda s: pack(s, target, carry, count), ArrayType(StringType()), pa.list_(pa.string()))


def packer_for(factory: Callable[[], object], target: int = TARGET_TOKENS):
    """A packer that counts with a model's own tokenizer and keeps within its window."""
    model = factory()
    return packer(min(target, model.max_tokens), count=model.count_tokens)


# ------------------------------------------------------------------ sections

def lines_of(text: str) -> str:
    """Lines by every line break Python's ``splitlines`` knows."""
    return f"split({text}, '\\r\\n|[\\n\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]')"


def fence_spans(lines: str) -> str:
    """array<struct<first, last>> of line numbers inside fenced code, fences included.

    Only the fence lines are folded; a fence closes on a line that starts with the mark that opened it.
    """
    mark = "regexp_extract(l, '(?U)^\\\\s*(```|~~~)', 1)"
    marks = f"filter(transform({lines}, (l, i) -> struct(i AS i, {mark} AS m)), x -> x.m <> '')"
    state = "named_struct('at', {a}, 'm', {m}, 'spans', {s})"
    start = state.format(a="-1", m="''", s="cast(array() AS array<struct<first:int,last:int>>)")
    opened = state.format(a="x.i", m="x.m", s="s.spans")
    closed = state.format(a="-1", m="''", s="array_append(s.spans, named_struct('first', s.at, 'last', x.i))")
    return (
        f"aggregate({marks}, {start}, (s, x) -> CASE WHEN s.m = '' THEN {opened} WHEN s.m = x.m THEN {closed} ELSE s END,"
        f" s -> if(s.m = '', s.spans, array_append(s.spans, named_struct('first', s.at, 'last', 2147483647))))"
    )


def headings(lines: str, spans: str) -> str:
    """array<struct<at, level, title>> of heading lines outside fenced code."""
    shape = "(?U)^(#{1,6})\\\\s+(.*?)\\\\s*#*\\\\s*$"
    hashed = f"filter(transform({lines}, (l, i) -> struct(i AS at, l AS l)), x -> startswith(x.l, '#'))"
    found = (
        f"transform({hashed}, x -> struct(x.at AS at, length(regexp_extract(x.l, '{shape}', 1)) AS level,"
        f" {X.strip(f'''regexp_extract(x.l, '{shape}', 2)''')} AS title))"
    )
    return f"filter({found}, h -> h.level > 0 AND NOT exists({spans}, f -> h.at BETWEEN f.first AND f.last))"


def heading_paths(heads: str) -> str:
    """array<struct<at, path>>: each heading with the chain of headings above it."""
    state = "named_struct('stack', {k}, 'out', {o})"
    start = state.format(
        k="cast(array() AS array<struct<level:int,title:string>>)", o="cast(array() AS array<struct<at:int,path:string>>)"
    )
    stack = "array_append(filter(s.stack, p -> p.level < h.level), named_struct('level', h.level, 'title', h.title))"
    path = f"array_join(transform({stack}, p -> p.title), ' > ')"
    step = state.format(k=stack, o=f"array_append(s.out, named_struct('at', h.at, 'path', {path}))")
    return f"aggregate({heads}, {start}, (s, h) -> {step}, s -> s.out)"


# A handler adds ``found``, the array of a file's sections (section, heading_path, body), for the rows where ``when`` holds.
FOUND = "array<struct<section:int,heading_path:string,body:string>>"


def find_markdown(docs: DataFrame, when: str = "true", text: str = "text", title: str = "title") -> DataFrame:
    """Sections by heading, fenced code left alone; blank ones are left out."""
    body = X.strip("array_join(slice(lines, m.at + 1, if(i + 1 < size(marks), marks[i + 1].at, size(lines)) - m.at), '\n')")
    path = f"coalesce(nullif(m.path, ''), nullif({title}, ''), '(preamble)')"
    staged = (
        docs.withColumn("lines", F.expr(f"if({when}, {lines_of(text)}, null)"))
        .withColumn("spans", F.expr(fence_spans("lines")))
        .withColumn("heads", F.expr(headings("lines", "spans")))
        .withColumn("marks", F.expr(f"concat(array(named_struct('at', 0, 'path', '')), {heading_paths('heads')})"))
    )
    found = f"transform(marks, (m, i) -> named_struct('section', i, 'heading_path', {path}, 'body', {body}))"
    return staged.withColumn("found", F.expr(f"if({when}, filter({found}, s -> s.body <> ''), null)")).drop("lines", "spans", "heads", "marks")


def find_html(docs: DataFrame, when: str = "true", text: str = "text", title: str = "title") -> DataFrame:
    """Visible text of a page as one section, located by its <title>."""
    bare = f"regexp_replace(regexp_replace({text}, '(?is)<!--.*?-->|<(script|style|noscript)[^>]*>.*?</\\\\1>', ''), '(?s)<[^>]+>', '')"
    head = f"regexp_extract({text}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    named = docs.withColumns({"raw": X.unescape_entities(F.expr(f"if({when}, {bare}, null)")), "head": X.unescape_entities(F.expr(f"if({when}, {head}, null)"))})
    body = f"array_join(filter(transform({lines_of('raw')}, l -> {X.strip('l')}), l -> l <> ''), '\n')"
    found = f"array(named_struct('section', 0, 'heading_path', coalesce(nullif({X.strip('head')}, ''), {title}), 'body', {body}))"
    return named.withColumn("found", F.expr(f"if({when}, filter({found}, s -> s.body <> ''), null)")).drop("raw", "head")


def find_text(docs: DataFrame, when: str = "true", text: str = "text", title: str = "title") -> DataFrame:
    """The whole text as one section without a path."""
    found = f"array(named_struct('section', 0, 'heading_path', cast(null AS string), 'body', {text}))"
    return docs.withColumn("found", F.expr(f"if({when}, {found}, null)"))


def sections_of(docs: DataFrame, text: str = "text", title: str = "title") -> DataFrame:
    """One row per non-blank section of Markdown texts: (…, section, heading_path, body).

    The sections are cut inside an outer generator: for an inner one the optimizer adds a filter on the size of the array,
    and with it computes the array and all it is made of once more.
    """
    cols = [c for c in docs.columns if c != text]
    staged = (
        docs.withColumn("lines", F.expr(lines_of(text)))
        .withColumn("spans", F.expr(fence_spans("lines")))
        .withColumn("heads", F.expr(headings("lines", "spans")))
        .withColumn("marks", F.expr(f"concat(array(named_struct('at', 0, 'path', '')), {heading_paths('heads')})"))
    )
    body = "array_join(slice(lines, m.at + 1, if(i + 1 < size(marks), marks[i + 1].at, size(lines)) - m.at), '\\n')"
    cut = staged.select(*cols, F.expr(f"posexplode_outer(transform(marks, (m, i) -> struct(m.path AS path, {body} AS body))) AS (section, s)")).where("section IS NOT NULL")
    return cut.selectExpr(
        *cols, "section", f"coalesce(nullif(s.path, ''), nullif({title}, ''), '(preamble)') AS heading_path", f"{X.strip('s.body')} AS body"
    ).where("body <> ''")


# Suffix -> how a file of that type becomes sections. A caller adds its own types here.
HANDLERS: dict[str, Callable[..., DataFrame]] = {"md": find_markdown, "txt": find_text, "html": find_html, "htm": find_html}


def pack_sections(sections: DataFrame, pack_column=None) -> DataFrame:
    """Chunks of every section. '(part N)' marks a section that splits; plain text counts its parts."""
    pack_column = pack_column or packer()
    cols = [c for c in sections.columns if c not in ("body", "heading_path")]
    packed = sections.withColumn("pieces", pack_column(F.expr(X.sentences("body"))))
    out = packed.select(*cols, "heading_path", F.size("pieces").alias("parts"), F.posexplode("pieces").alias("part", "text"))
    locator = (
        "CASE WHEN heading_path IS NULL THEN if(parts = 1, 'full text', concat('part ', part + 1))"
        " WHEN parts = 1 THEN heading_path ELSE concat(heading_path, ' (part ', part + 1, ')') END"
    )
    return out.selectExpr(
        *cols, "part", f"{locator} AS locator", "text", f"{X.short_hash('text')} AS content_hash"
    )


def chunk_files(files: DataFrame, pack_column=None, handlers=None) -> DataFrame:
    """files (collection, path, text) -> chunk rows with a stable id."""
    suffixed = files.selectExpr(
        "collection", "path AS source_path", "text",
        "regexp_replace(substring_index(path, '/', -1), '\\\\.[^.]*$', '') AS title", f"{X.extension('path')} AS suffix",
    )
    # One scan: each handler fills in the sections of its own files, and whatever one leaves null stays for the others.
    by_handler: dict[Callable, list[str]] = {}
    for suffix, handler in (handlers or HANDLERS).items():
        by_handler.setdefault(handler, []).append(suffix)
    staged = suffixed.withColumn("sections", F.expr(f"cast(null AS {FOUND})"))
    for handler, suffixes in by_handler.items():
        mine = "suffix IN (" + ", ".join(f"'{x}'" for x in suffixes) + ")"
        staged = handler(staged, mine).withColumn("sections", F.expr("coalesce(sections, found)")).drop("found")
    # An outer generator, so that the sections are not computed again for a filter on their number.
    sections = staged.select("collection", "source_path", "title", "suffix", F.expr("inline_outer(sections)")).where("section IS NOT NULL")
    chunks = pack_sections(sections.drop("title", "suffix"), pack_column)
    return chunks.selectExpr(
        "xxhash64(collection, source_path, section, part, content_hash) AS chunk_id", "collection", "source_path", "section", "part",
        "locator", "text", "content_hash",
    )


def unsupported_files(files: DataFrame, handlers=None) -> DataFrame:
    """Files of a type no handler knows, as failure rows."""
    known = list(handlers or HANDLERS)
    return files.withColumn("suffix", F.expr(X.extension("path"))).where(~F.col("suffix").isin(*known)).selectExpr(
        "collection", "path", "concat('Unsupported file type ', suffix) AS reason"
    )


def file_failures(files: DataFrame, handlers=None) -> DataFrame:
    """Every file that gives no chunks with its reason: (collection, path, text, failure) as decoding left them."""
    known = ", ".join(f"'{k}'" for k in handlers or HANDLERS)
    blank = f"length({X.strip('text')}) = 0"
    reason = (
        f"CASE WHEN {X.extension('path')} NOT IN ({known}) THEN concat('Unsupported file type ', {X.extension('path')})"
        f" WHEN failure IS NOT NULL THEN failure WHEN text IS NULL OR {blank} THEN '{ZERO_CHUNKS}' END"
    )
    return files.selectExpr("collection", "path", f"{reason} AS reason").where("reason IS NOT NULL")
