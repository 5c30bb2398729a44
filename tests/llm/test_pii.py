"""Personal data: base spans against the plain patterns, added spans, and the boosted trees."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import boosting, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


CARD, OTHER = "4539578763621486", "4556737586899855"
TEXTS = [
    None,
    "",
    "plain words only",
    "ann.b@x.org, bob@y.co.uk@z.de a@b.c.d_e@f.g @no.x x@y",
    "ip 1.2.3.4 and 300.1.1.1, 1.2.3.4.5.6.7.8, 001.02.0003.4 1.2.3.99999999999999999999",
    f"{CARD} {OTHER}",
    f"card {CARD}, {CARD[:4]}-{CARD[4:8]}-{CARD[8:12]}-{CARD[12:]} {'9' * 40} {CARD[:15]}",
    "5 - 4539578763621486 x12  4539578763621486  1 4539578763621486",
    "+1 (826) 555-4081 190.137.223.204 and +49 30 1234567. +1+2+33 4444 5555 ++7 1",
    "é😀 ü ann@x.org 😀 +1 (826) 555-4081 é",
    "7" * 30_000 + " " + "a" * 30_000 + " x@y.z" + "1 " * 20_000,
    "x@y" + ".z" * 30_000 + " 1" + ".2" * 30_000 + " +" + "3(" * 30_000,
    "write to ann (at) example (dot) org today",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", "y")]
    rows += [(100 + i, f"ann{i}@x.org {CARD} 1.2.3.{i} +1 (826) 555-408{i % 10} 999.1.2.3 1111 2222 3333 444{i % 10}", "", "") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, wide string")
    return docs, pii.redactions(docs).collect()


def test_base_spans(found):
    for r in found[1]:
        if r.doc_id < 100:
            assert [tuple(s) for s in r.base] == base_spans(TEXTS[r.doc_id]), r.doc_id
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert len(found[1]) == len(TEXTS) + 1 + 60


def test_added_spans(found):
    by_id = {r.doc_id: [tuple(s) for s in r.spans] for r in found[1]}
    assert by_id[5] == [("card", 0, 16), ("card", 17, 33)]
    assert ("phone", 0, 17) in by_id[8] and ("ip", 18, 33) in by_id[8]


def test_empty_table(spark):
    assert pii.redactions(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redacted_text(spark):
    row = spark.sql("SELECT 'mail ann@x.org or 1.2.3.4!' AS t, array(named_struct('kind','email','start',5,'end',14), named_struct('kind','ip','start',18,'end',25)) AS s")
    assert row.select(pii.redacted(F.col("t"), F.col("s"))).first()[0] == "mail <email> or <ip>!"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.tuples(st.integers(0, 3), st.integers(0, 1)), st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=8))
def test_trees_never_lose_on_training_loss(rows):
    from math import exp, log

    rows = [(x, float(p), float(n)) for x, p, n in rows]
    model = boosting.fit(rows)
    loss = lambda m: sum(p * log(1 + exp(-boosting.score(m, x))) + n * log(1 + exp(boosting.score(m, x))) for x, p, n in rows)
    assert loss(model) <= loss((model[0], [])) + 1e-6


def test_digest_order(found):
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(TEXTS[6]))
    row = next(r for r in found[1] if r.doc_id == 6)
    joined = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in row.base)
    assert hashlib.sha256(text.encode()).digest() == hashlib.sha256(joined.encode()).digest()


GROUPED = [
    "453 957 876 362 148 6",
    "pay 4 5 3 9 5 7 8 7 6 3 6 2 1 4 8 6 now",
    "45-39-57-87-63-62-14-86",
    "1 2 3 and 453-957-876-362-148-7",
    "amex 378282246310005 only",
]


def test_cards_in_short_groups(spark):
    docs = spark.createDataFrame(list(enumerate(GROUPED)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.candidates(docs).collect()}
    for i, text in enumerate(GROUPED):
        assert [tuple(s) for s in found[i].base] == base_spans(text), text
    assert sum(len(found[i].base) for i in range(3)) == 3
    assert [(c.name, c.start, c.end) for c in found[4].wide] == [("card", 5, 20)]


def test_context_decides(spark):
    rows = [(i, f"{i} e-mail ann.lee@mail.example.com") for i in range(80)] + [(100 + i, f"{i} visit us at example.com") for i in range(80)]
    rows += [(200 + i, f"{i} card {CARD}") for i in range(80)] + [(300 + i, f"{i} order no {CARD}") for i in range(80)]
    asked = ["e-mail bob at example.com", "find bob at example.com", "e-mail us at example.com", f"card {CARD} {OTHER}", f"xx {CARD} {OTHER}"]
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.redactions(docs).collect()}
    assert [got[1000 + i] for i in range(3)] == [[("email", 7, 25)], [], []]
    assert got[1003] == [("card", 5, 21)] and got[1004] == []
    assert all(got[100 + i] == [] for i in range(80)) and all(len(got[300 + i]) == 1 for i in range(80))
    assert "valid" not in pii.FEATURES
