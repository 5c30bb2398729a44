"""SimHash fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import components, simhash
from ledgerloom.llm.shared import Scratch


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, max_bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBé\x0b\t \n ß😀"), max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near(rng, n):
    """Fingerprints in clusters of chained neighbours at 3 to 5 bits."""
    out = []
    while len(out) < n:
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            for b in rng.sample(range(64), rng.choice([3, 4, 4, 5])):
                fp ^= 1 << b
            out.append(fp)
    return sorted(set(out[:n]))


@pytest.mark.parametrize(("block", "coalesce"), [(4096, "true"), (7, "false")])
def test_links_and_components(spark, block, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        fps = near(random.Random(block), 700)
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), block=block)
        found = edges.collect()
        assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 4 for r in found) and len(found) < 36 * len(fps)
        roots = {r.node: r.root for r in components.components(edges, Scratch(spark, "t")).collect()}
        want = plain_components(fps)
        groups, got = {}, {}
        for i, s in enumerate(signed):
            groups.setdefault(want[i], set()).add(s)
            got.setdefault(roots.get(s, s), set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))
        assert all(min(g) == root for root, g in got.items())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (900, 901), (901, 900)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}
    assert components.components(edges.limit(0), Scratch(spark, "t")).count() == 0


def test_forest_connects_exactly():
    rng = np.random.default_rng(1)
    fps = np.unique((rng.integers(0, 2**10, 400).astype(np.uint64)) << np.uint64(20))
    edges = simhash.forest(fps, 2)
    assert len(edges) < len(fps) and all(int(a ^ b).bit_count() <= 2 for a, b in edges)


def test_documents(spark, tmp_path):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(30)]
    rows = []
    for i in range(240):
        t = base[i % 30].split()
        for _ in range(i // 90):
            t[rng.randrange(200)] = "changed"
        rows.append((i, " ".join(t), "x", 0))
    rows += [(500, None, "x", 0), (501, "", "x", 0), (501, "", "x", 0), (502, " \t\n", "x", 0), (503, "long " * 50_000, "x", 0), (None, rows[0][1], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    comp = plain_components(fps)
    least = {}
    for (d, *_), c in zip(rows, comp, strict=True):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    key = lambda d, f, c: (str(d), f & (2**64 - 1), c)
    want = sorted(key(d, f, least[c]) for (d, *_), f, c in zip(rows, fps, comp, strict=True))
    assert sorted(key(r.doc_id, r.fp, r.component_id) for r in got) == want
    docs.write.parquet(str(tmp_path / "d"))
    kept = simhash.representative_rows(spark.read.parquet(str(tmp_path / "d")))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
