"""Text expressions against the language's own tools."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions import titles as H
from ledgerloom.operators import grading as G
from ledgerloom.operators import upkeep as U


def value(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return row.select(F.expr(expression).alias("x")).first().x


def plain_fold(s):
    s = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", s)).lower()
    s = re.sub(r"\[[^\]]*\]", " ", re.sub(r"\([^)]*\)", " ", s))
    return re.sub("[^a-z0-9]+", " ", re.sub(r"\b\d{1,2}:\d{2}\s*(?:am|pm)?\b", " ", s)).strip()


def test_fold_words_is_compatibility_folding(spark):
    letters = [chr(c) for c in range(0xA0, 0x2FFF) if unicodedata.category(chr(c))[0] in "LN"]
    texts = ["".join(letters[i : i + 60]) for i in range(0, len(letters), 60)]
    texts += ["Ča̋ś ﬁne Ⅷ ½ ㎏ İstanbul", "Ch 11 (draft) [x] 10:30 am Größe", "ŁódŹ naïve été"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.expr(H.fold_words_text("t")).alias("x")).collect()
    assert [r.x for r in rows] == [plain_fold(r.t) for r in rows]


@pytest.mark.parametrize(
    ("url", "label"),
    [("https://h.org/a/b/", "https://h.org/..."), ("https://h.org", "https://h.org/..."), ("https://h.org/a/tok/basic.ics?x=1", "https://h.org/.../basic.ics"),
     ("/local/path", "/local/path"), ("https://[::1/a", "<feed url hidden>"), ("https://[::1]/a", "https://[::1]/.../a")],
)
def test_label_url(spark, url, label):
    assert value(spark, X.label_url("u"), u=url) == label


@pytest.mark.parametrize(
    ("url", "target"),
    [("https://x.safelinks.protection.outlook.com/?url=https%3A%2F%2Fa.org%2Fb%2520c&data=1", "https://a.org/b c"), ("https://a.org/%zz", "https://a.org/%zz"),
     ("https://x.safelinks.protection.outlook.com/?url=%zz", "%zz"), ("https://safelinks.protection.outlook.com:bad port/?url=x", None)],
)
def test_safelinks_never_fail(spark, url, target):
    got = value(spark, X.unwrap_safelink("u"), u=url)
    assert got == target or target in (None, "%zz") and got in (url, "%zz")


@pytest.mark.parametrize(("number", "text"), [("100", "100"), ("9.50", "9.5"), ("10.00", "10"), ("0.05", "0.05"), ("1200.0", "1200")])
def test_short_number(spark, number, text):
    assert value(spark, G.short_number("n"), n=number) == text
    if "." not in number:
        assert value(spark, G.short_number("cast(n AS int)"), n=number) == text


def test_note_names(spark):
    notes = spark.createDataFrame([("oaks-quiz-7", "C", "Same name", "t"), ("oaks-quiz-3", "C", "Same name", "t")], "id string, course string, name string, text string")
    assert {r.path for r in U.note_paths(notes).collect()} == {"C/_synced/quizzes/same-name.md", "C/_synced/quizzes/same-name-7.md"}


def test_file_manifest(spark, tmp_path):
    from ledgerloom.sources.files import file_manifest

    for name in ("a.md", "b/c.PDF", "b/._d.md", "e.xyz"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("12345")
    got = file_manifest(spark, [str(tmp_path)], "lib").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.size, r.collection) for r in got) == [("a.md", 5, "lib"), ("c.PDF", 5, "lib")]
