"""The manifest against a plain tree built level by level on one machine."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle
from ledgerloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, path string, block string, found string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes, fanout):
    """The root and, for every node, its siblings left and right at each level."""
    out, span, proofs = list(nodes), 1, [[] for _ in nodes]
    while len(out) > 1:
        for i, proof in enumerate(proofs):
            at = i // span
            run = at - at % fanout
            proof.append((out[run:at], out[at + 1 : run + fanout]))
        out = [h(*out[i : i + fanout]) for i in range(0, len(out), fanout)]
        span *= fanout
    return out[0], proofs


def plain(rows, fanout=8):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of rows (doc_id, text, lang, source, n_chars)."""
    trees = defaultdict(list)
    for r in rows:
        d, text, lang, source, n = r
        own = plain_leaf(d, source, lang, n, text)
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        low = None if text is None else text.translate({c: c + 32 for c in range(65, 91)})
        found = plain_leaf(d, source, lang, n, low) if hit else own
        trees[lang].append(((d is not None, d or 0), own, d, found))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: (x[0], x[1]))
    tops = [levels_of([x[1] for x in trees[k]], fanout) for k in order]
    root, above = levels_of([t[0] for t in tops], fanout)
    out = []
    for k, (subroot, below), up in zip(order, tops, above, strict=True):
        for (_, own, d, found), proof in zip(trees[k], below, strict=True):
            folded, siblings = found, []
            for left, right in proof + up:
                folded = h(*left, folded, *right)
                siblings += left + right
            out.append((str(d), own, subroot, root, h(*siblings), folded, folded == root))
    return sorted(out)


def got(spark, rows, fanout, levels):
    docs = spark.createDataFrame([(*r, "t", 5, "p", "b", "f") for r in rows], SCHEMA).repartition(3)
    found = merkle.verified(merkle.manifest(docs, {"found": merkle.tampered_leaf()}, fanout=fanout, levels=levels))
    found = found.withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in found)


AWKWARD = [
    (1, "Upper Case", "en", "a", 10), (1, "Upper Case", "en", "a", 10), (1, "other", "en", "a", 5), (None, None, None, None, None),
    (None, "", None, "b", 0), (2, "", "", "", 0), (3, "É Übel 日本 A-Z", "de", None, -4), (6, "X" * 100_000, "de", "c", 100_000), (9, "ONE", "日", "s", 1),
]


@pytest.mark.parametrize(("fanout", "levels"), [(8, 4), (2, 1), (3, 1)])
def test_awkward_rows(spark, fanout, levels):
    assert got(spark, AWKWARD, fanout, levels) == plain(AWKWARD, fanout)


@pytest.mark.parametrize(("fanout", "levels", "n"), [(2, 1, 37), (3, 1, 100), (2, 2, 64), (8, 1, 700)])
def test_ragged_butterfly(spark, fanout, levels, n):
    """Several rounds, the last subtrees incomplete: a third of the rows in one tree, and a tree for each of many rows."""
    rng = random.Random(n)
    rows = [(i, f"Text {rng.random()}", "big" if i % 3 == 0 else rng.choice([f"l{i}", "mid", None]), "s", i) for i in range(n)]
    assert got(spark, rows, fanout, levels) == plain(rows, fanout)


def test_empty_and_one_row(spark):
    assert got(spark, [], 8, 4) == []
    one = [(7, "Only", "en", "s", 4)]
    assert got(spark, one, 8, 4) == plain(one)
    assert plain(one)[0][2] == plain(one)[0][1] and plain(one)[0][4] == h()


def test_heights(spark):
    for fanout in (2, 8):
        numbers = sorted({max(1, fanout**k + d) for k in range(1, 6) for d in (-1, 0, 1)})
        found = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", merkle.heights(F.col("n"), fanout).alias("k")).collect()
        for r in found:
            k, m = 0, r.n
            while m > 1:
                m, k = -(-m // fanout), k + 1
            assert r.k == k


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = QUERIES["op12_merkle_manifest"](spark, sf).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found) == plain(rows)
    assert {r.verified for r in found} == {True, False}
