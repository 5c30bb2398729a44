"""Packing, sections and decoding on small fixtures."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import chunking as K
from ledgerloom.sources.files import decode_files, glob_regex


def replay(sentences, target, overlap, count):
    """Plain packing, one sentence at a time, to compare the span arithmetic with."""
    done, open_ = [], []
    for s in sentences:
        if open_ and sum(map(count, open_)) + count(s) > target:
            done.append(open_)
            room, tail = max(0, min(overlap, target - count(s))), []
            while len(tail) < len(open_) and sum(map(count, tail)) + count(open_[-len(tail) - 1]) <= room:
                tail = open_[-len(tail) - 1 :]
            open_ = [] if len(tail) == len(open_) else list(tail)
        open_ = open_ + [s]
    return ["\n".join(c) for c in done + ([open_] if open_ else [])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 160), max_size=40), st.integers(10, 60), st.integers(0, 30))
def test_pack_equals_replay(lengths, target, overlap):
    sentences = [chr(97 + i % 26) * n for i, n in enumerate(lengths) if K.estimate("x" * n) <= target]
    assert K.pack(sentences, target, overlap, K.estimate) == replay(sentences, target, overlap, K.estimate)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=30), st.integers(5, 40))
def test_no_chunk_exceeds_target_and_nothing_is_lost(lengths, target):
    text = " ".join(chr(97 + i % 26) * n for i, n in enumerate(lengths))
    chunks = K.pack([text], target, 0, K.estimate)
    assert all(sum(K.estimate(u) for u in c.split("\n")) <= target or len(c) <= 4 for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())


def test_custom_tokenizer_and_scaled_overlap():
    assert K.overlap_for(400) == 50 and K.overlap_for(1) == 1
    words = lambda s: len(s.split())
    assert K.pack(["a b c", "d e", "f g h i"], 5, 2, words) == ["a b c\nd e", "f g h i"]


def test_markdown_sections(spark):
    text = "intro\n# A\none\n```\n# no\n```\n## B\ntwo\n### C #\nthree\n## D\nfour\n# E\n\n"
    rows = K.sections_of(spark.createDataFrame([(1, "note", text)], "id int, title string, text string")).orderBy("section").collect()
    assert [(r.heading_path, r.body) for r in rows] == [
        ("note", "intro"), ("A", "# A\none\n```\n# no\n```"), ("A > B", "## B\ntwo"), ("A > B > C", "### C #\nthree"),
        ("A > D", "## D\nfour"), ("E", "# E"),
    ]


def test_unclosed_fence_hides_headings(spark):
    df = spark.createDataFrame([(1, "", "~~~\n# x\n```\n# y")], "id int, title string, text string")
    assert [r.heading_path for r in K.sections_of(df).collect()] == ["(preamble)"]


def test_chunk_files_by_type(spark):
    files = spark.createDataFrame(
        [("c", "c/a.md", "# T\nHello there. Bye."), ("c", "c/b.TXT", "One. Two."), ("c", "c/e.html", "<title>P &amp; Q</title><p>Hi</p><script>x</script>"), ("c", "c/d.xyz", "?")],
        "collection string, path string, text string",
    )
    got = {r.source_path: (r.locator, r.text) for r in K.chunk_files(files).collect()}
    assert got == {"c/a.md": ("T", "# T\nHello there.\nBye."), "c/b.TXT": ("full text", "One.\nTwo."), "c/e.html": ("P & Q", "P & QHi")}
    assert [r.path for r in K.unsupported_files(files).collect()] == ["c/d.xyz"]


def test_long_text_counts_its_parts(spark):
    body = " ".join(f"Sentence number {i} is here." for i in range(100))
    sections = spark.createDataFrame([(1, 0, None, body), (2, 0, "H", body)], "id int, section int, heading_path string, body string")
    rows = K.pack_sections(sections, K.packer(200)).orderBy("id", "part").collect()
    plain = [r.locator for r in rows if r.id == 1]
    assert plain[0] == "part 1" and len(plain) > 2 and [r.locator for r in rows if r.id == 2][0] == "H (part 1)"


def test_decoding(spark):
    cases = {
        "utf8": "héllo".encode(), "bom": b"\xef\xbb\xbf# x", "u16le": b"\xff\xfe" + "hé".encode("utf-16-le"), "u16be": b"\xfe\xff" + "hé".encode("utf-16-be"),
        "u32": b"\xff\xfe\x00\x00" + "hé".encode("utf-32-le"), "bare16": "héé".encode("utf-16-le"), "latin": b"caf\xe9",
        "odd": b"\xff\xfeA", "other order": "\u00d8\u00dbab".encode("utf-16-be"), "neither": b"\x00\xd8\x00" * 9, "torn mark": b"\xef\xbb\xbf\xff", "empty": b"",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "k string, content binary")
    rows = decode_files(df).collect()
    assert {r.k: r.text for r in rows if r.failure is None} == {
        "utf8": "héllo", "bom": "# x", "u16le": "hé", "u16be": "hé", "u32": "hé", "bare16": "héé", "latin": "café", "empty": "", "other order": "\u00d8\u00dbab"
    }
    assert {r.k for r in rows if r.failure} == {"odd", "neither", "torn mark"}


def test_globs():
    import re

    match = lambda p, path: re.match(glob_regex(p), path.lower()) is not None
    assert match("**/*.pdf", "Lecture.PDF") and match("**/*.pdf", "a/b/c.pdf") and not match("*.md", "x.txt")
    assert match("**/._*", "a/._x.pdf") and match("**/__MACOSX/**", "z/__MACOSX/a.md")
