"""Suffix de-duplication against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import suffix_dedup as sd


def plain(rows, length=50):
    """doc_id, n_bytes, n_removed, n_spans, kept hash of every row, window by window."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if first[b[i : i + length]] < d:
                    gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        n = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(b), int(gone.sum()), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=25))
def test_previous_factors(pairs):
    position = np.array([p for p, _ in pairs])
    lcp = np.array([0, *(x for _, x in pairs[1:])])
    got = sd.longest_previous_factors(lcp, position)
    for i in range(len(pairs)):
        best = 0
        for j in range(len(pairs)):
            if position[j] < position[i]:
                a, b = sorted((i, j))
                best = max(best, int(lcp[a + 1 : b + 1].min()))
        assert got[i] == best


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["ab", "cde", "fgh", "ijkl", "é", "the", "\x00", "z" * 30]
    passages = [" ".join(rng.choices(words, k=40)) for _ in range(5)]
    rows = []
    for i in range(n):
        t = " ".join(rng.choices([f"{w}{rng.randrange(99)}" for w in words], k=rng.randrange(60)))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 60)
            t += p[a : a + rng.randrange(45, 120)]
        rows.append((i * 7 % n, t))
    rows += [(n + 1, "y" * 400), (n + 2, "y" * 49), (n + 3, "y" * 50), (n + 4, "x" + "y" * 60 + "x"), (n + 5, None), (n + 6, "")]
    rows += [(3, rows[3][1]), (200, rows[10][1]), (201, rows[10][1]), (5, passages[0]), (None, passages[1] + "tail"), (None, passages[1])]
    rows += [(300 + i, "head%d " % i + passages[2][:80] + " tail%d" % i) for i in range(40)]
    return rows


@pytest.mark.parametrize(("seed", "together", "coalesce"), [(1, 2000, "true"), (2, 3, "false")])
def test_documents(spark, monkeypatch, seed, together, coalesce):
    monkeypatch.setattr(sd, "TOGETHER", together)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, "c", 0) for d, t in rows], "doc_id long, text string, sha string, n_bytes int")
        got = sd.deduplicated(docs.repartition(3)).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_text_and_empty_table(spark):
    long = " ".join(str(i) for i in range(150_000))
    docs = spark.createDataFrame([(1, long), (2, "start " + long + " end"), (3, long[5000:5049]), (4, long[5000:5051])], "doc_id long, text string")
    got = {r.doc_id: r for r in sd.deduplicated(docs, with_text=True).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed, got[4].n_removed) == (0, len(long), 0, 51)
    assert bytes(got[2].kept) == b"start  end"
    assert sd.deduplicated(docs.limit(0)).count() == 0


def test_large_repeated_and_text_ids(spark):
    """Ids near the end of the longs, repeated ones among them, and ids that are texts, decimals or bytes of a number."""
    rows = [(None if d is None else d, t) for d, t in corpus(5, 60)]
    big = [(None if d is None else 2**63 - 1 - 1000 + d, t) for d, t in rows] + [(-(2**63), rows[4][1])] * 2
    for data, kind in ((big, "long"), ([(None if d is None else f"id{d:05d}é", t) for d, t in rows], "string"), ([(d, t) for d, t in rows], "decimal(20,0)")):
        cast = "cast(d AS decimal(20,0))" if kind.startswith("decimal") else "d"
        docs = spark.createDataFrame(data, f"d {'long' if kind != 'string' else kind}, text string").selectExpr(f"{cast} AS doc_id", "text", "1 AS rank", "2 AS id", "'x' AS tree")
        got = sd.deduplicated(docs.repartition(3)).collect()
        want = plain(data)
        assert sorted(((None if r.doc_id is None else r.doc_id if kind != "decimal(20,0)" else int(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == want
    assert sd.deduplicated(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_runs_are_equal_by_more_than_the_packed_hash(spark, monkeypatch):
    """Where all packed run hashes clash, the second hash keeps different runs apart."""
    plain_runs = sd.runs_of
    monkeypatch.setattr(sd, "runs_of", lambda texts: (lambda g, n, *rest: (g, np.zeros_like(n), *rest))(*plain_runs(texts)))
    rows = corpus(7, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sd.deduplicated(docs.repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == plain(rows)
