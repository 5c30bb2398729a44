"""Expressions over titles: kinds, matching keys, estimates, slugs. Each returns SQL text for ``F.expr``."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import patterns as P
from ledgerloom.functions.patterns import literal, word_match


def _array(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def classify_kind(title: str) -> str:
    """Kind of a calendar title; anything unrecognised is 'admin'."""
    return (
        f"CASE WHEN {word_match(title, P.EXAM_WORDS)} THEN 'exam' WHEN {word_match(title, P.QUIZ_WORDS)} THEN 'quiz'"
        f" WHEN {word_match(title, P.PROJECT_WORDS)} THEN 'project' ELSE 'admin' END"
    )


def classify_connector(title: str) -> str:
    """Kind of a pulled title; anything unrecognised is a dated 'quiz'."""
    return (
        f"CASE WHEN {word_match(title, P.SITE_ADMIN_STRONG)} THEN 'admin'"
        f" WHEN rlike({title}, {literal('(?iU)' + P.WEEK_TOPIC)}) THEN 'admin'"
        f" WHEN {word_match(title, P.SITE_PROJECT_WORDS)} THEN 'project'"
        f" WHEN {word_match(title, P.SITE_EXAM_WORDS)} THEN 'exam'"
        f" WHEN {word_match(title, P.QUIZ_WORDS)} THEN 'quiz'"
        f" WHEN {word_match(title, P.SITE_ADMIN_WEAK)} THEN 'admin' ELSE 'quiz' END"
    )


def looks_graded(title: str, kind: str) -> str:
    """Exam and project kinds are trusted; a quiz needs evidence in its title."""
    return f"({kind} IN ('exam', 'project') OR ({kind} = 'quiz' AND {word_match(f'coalesce({title}, {chr(39)*2})', P.GRADED_WORDS)}))"


def ensure_where(title: str, where: str) -> str:
    """Append ' (where)' unless the title already names a place."""
    return f"if({word_match(title, P.LOCATION_WORDS)}, {title}, concat({title}, ' ({where})'))"


def _bare(title: str) -> str:
    """Lower-case title without bracketed notes, '&' spelled out."""
    return f"replace(regexp_replace(lower({title}), '\\\\[[^\\\\]]*\\\\]|\\\\([^)]*\\\\)', ' '), '&', ' and ')"


def key_words(title: str) -> str:
    """Distinct content words of a title, in order."""
    return words_of(_bare(title))


def key_numbers(title: str) -> str:
    """Number signature: whole-word digit runs joined by '-'."""
    return numbers_of(_bare(title))


def words_of(bare: str) -> str:
    """The pattern takes only words with a letter in them, so pure numbers never match."""
    return f"array_except(regexp_extract_all({bare}, '[a-z0-9]*[a-z][a-z0-9]*', 0), {_array(P.KEY_STOPWORDS)})"


def numbers_of(bare: str) -> str:
    return f"array_join(regexp_extract_all({bare}, '(?U)\\\\b([0-9]+)\\\\b', 1), '-')"


def with_title_parts(df: DataFrame, course: str = "course", title: str = "title") -> DataFrame:
    """Add key, up, words and nums, computing each from the one before; a table that has them stays as it is."""
    if {"key", "up", "words", "nums"} <= set(df.columns):
        return df
    return (
        df.withColumn("bare", F.expr(_bare(title)))
        .withColumns({"up": F.expr(f"upper({course})"), "words": F.expr(words_of("bare")), "nums": F.expr(numbers_of("bare"))})
        .withColumn("key", F.expr("concat(up, '|', array_join(slice(words, 1, 3), ' '), '|', nums)"))
        .drop("bare")
    )


def title_key(course: str, title: str) -> str:
    """Identity of a piece of work: course, first three content words, numbers."""
    return f"concat(upper({course}), '|', array_join(slice({key_words(title)}, 1, 3), ' '), '|', {key_numbers(title)})"


def dept_word(course: str) -> str:
    return f"lower(regexp_extract({course}, '^\\\\s*([A-Za-z]+)\\\\s*-?\\\\s*0*([0-9]+)', 1))"


def course_number(course: str) -> str:
    return f"regexp_extract({course}, '^\\\\s*([A-Za-z]+)\\\\s*-?\\\\s*0*([0-9]+)', 2)"


def estimate_minutes(title: str) -> str:
    """'est 1h 10m' or '(25m)' as minutes, null without an estimate."""
    text = (
        f"coalesce(nullif(regexp_extract({title}, {literal('(?i)' + P.ESTIMATE)}, 1), ''),"
        f" nullif(regexp_extract({title}, {literal('(?i)' + P.ESTIMATE)}, 2), ''))"
    )
    hours = f"coalesce(cast(nullif(regexp_extract({text}, '([0-9]+)h', 1), '') AS int), 0)"
    minutes = f"cast(nullif(regexp_extract({text}, '([0-9]+)m', 1), '') AS int)"
    return f"{hours} * 60 + {minutes}"


def strip_aside(title: str) -> str:
    """Title without a trailing [aside]; a title that is only an aside stays."""
    return f"coalesce(nullif(trim(regexp_replace({title}, '\\\\s*\\\\[[^\\\\]]*\\\\]\\\\s*$', '')), ''), {title})"


def slugify(text: str, limit: int = 48) -> str:
    dashed = f"lower(regexp_replace(regexp_replace({text}, '[^A-Za-z0-9]+', '-'), '^-+|-+$', ''))"
    return f"coalesce(nullif(rtrim('-', substring({dashed}, 1, {limit})), ''), 'announcement')"


@cache
def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Letters whose compatibility decomposition, less accents, holds a Latin letter or digit: to one character, to several.

    Built from the Unicode database, not by hand.
    """
    one, many = {}, {}
    for code in range(0x80, 0x30000):
        c = chr(code)
        plain = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", c)).lower()
        if plain != c and re.search("[a-z0-9]", plain):
            (one if len(plain) == 1 else many)[c] = plain
    return one, many


def _literal(text: str) -> str:
    return "'" + text.replace("'", "\'") + "'"


def _ranges(letters) -> str:
    """The letters as ranges of a pattern's character class: a long list of single ones is slow to match."""
    codes, out = sorted(map(ord, letters)), []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


def fold_words_text(text: str) -> str:
    """Accent-free lower-case words of a text as one space-separated string, compatibility forms resolved."""
    one, many = _compatible()
    table = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in many.items())
    spelled = f"array_join(transform(split({text}, ''), c -> coalesce(try_element_at(map({table}), c), c)), '')"
    wide = f"if(rlike({text}, '[{_ranges(many)}]'), {spelled}, {text})"
    accented = f"translate(regexp_replace({wide}, '[\u0300-\u036f]', ''), '{''.join(one)}', '{''.join(one.values())}')"
    # Most texts are plain ASCII and need none of this.
    folded = f"lower(if(octet_length({text}) = char_length({text}), {text}, {accented}))"
    no_notes = f"regexp_replace(regexp_replace({folded}, '\\\\([^)]*\\\\)', ' '), '\\\\[[^\\\\]]*\\\\]', ' ')"
    no_clock = f"regexp_replace({no_notes}, '\\\\b[0-9]{{1,2}}:[0-9]{{2}}\\\\s*(?:am|pm)?\\\\b', ' ')"
    return f"trim(regexp_replace({no_clock}, '[^a-z0-9]+', ' '))"


def run_words(text: str) -> str:
    """Words a strict match compares: no stopwords, no lone letters."""
    return run_words_of(fold_words_text(text))


def run_words_of(folded: str) -> str:
    return (
        f"filter(split({folded}, ' '), w -> NOT array_contains({_array(['', *P.RUN_STOPWORDS])}, w)"
        f" AND (length(w) > 1 OR w BETWEEN '0' AND '9'))"
    )


def run_numbers_of(folded: str, course: str) -> str:
    """Sorted distinct numerals, without the course's own digits."""
    code = f"regexp_replace({course}, '[^0-9]', '')"
    return f"array_sort(array_remove(array_distinct(regexp_extract_all({folded}, '[0-9]+', 0)), {code}))"
