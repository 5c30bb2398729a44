"""Sharding, mixing, exact de-duplication and quality rules against brute force, with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, mixing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, kept string, _row string"
TEXTS = [
    (1, "Hello World", "en", "a"),
    (2, "hello world", "en", "a"),
    (2, "hello world", "en", "a"),
    (3, "HELLO wörld", None, "a"),
    (4, "hello wÖrld", "de", None),
    (5, None, "de", "b"),
    (6, "", None, None),
    (7, "  \t ", "en", "a"),
    (None, "x" * 50, "en", "a"),
    (None, "X" * 50, "en", "a"),
    (9, "a b c d e a b c d e f " * 30, "en", "b"),
    (10, "long " * 30_000, "en", "b"),
    (11, "LONG " * 30_000, "en", "b"),
    (12, "long " * 29_999 + "lonG!", "en", "b"),
    (13, "one | two\n\none | two\n###  thrée four five six seven eight nine ten", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, 0, "n", "k", "r") for t in TEXTS], SCHEMA).cache()


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("block", [16, 16_384])
def test_exact_groups(docs, block):
    got = exact_dedup.groups(docs, block).collect()
    assert len(got) == len(TEXTS)
    sizes = Counter(lowered(t[1]) for t in TEXTS)
    best = defaultdict(lambda: -1)
    for d, t, *_ in TEXTS:
        best[lowered(t)] = max(best[lowered(t)], -1 if d is None else d)
    want = sorted(
        (str(d), best[lowered(t)], sizes[lowered(t)], hashlib.sha256(lowered(t).encode()).hexdigest()) for d, t, *_ in TEXTS
    )
    assert sorted((str(r.doc_id), -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(sizes)


def test_exact_salted_hot_block(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALTS", 4)
    rows = [(i, "Same text" if i % 3 else f"text {i}") for i in range(400)]
    got = exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.keep_id for r in got if r.doc_id % 3} == {398}
    assert {r.group_size for r in got if r.doc_id % 3} == {266} and sum(r.kept for r in got) == 135


def test_kept_rows_keep_columns(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    out = exact_dedup.kept_rows(spark.read.parquet(str(tmp_path / "d")))
    assert out.columns == docs.columns and out.count() == len({lowered(t[1]) for t in TEXTS})


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 63, 64, 65, 1000, 1023, 4099])
def test_permutation_is_one_to_one(spark, n):
    p = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 7).alias("p"))
    back = p.select("id", "p", sharding.permuted(F.col("p"), n, 7, back=True).alias("b")).collect()
    assert sorted(r.p for r in back) == list(range(n)) and all(r.b == r.id for r in back)


def test_shards(docs):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(TEXTS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in TEXTS
    )
    again = sharding.shard(docs.repartition(3), 4).collect()
    key = lambda r: tuple(map(str, (r.doc_id, r.size, r.text_crc32, r.shard, r.slot)))
    assert sorted(map(key, got)) == sorted(map(key, again))


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
    )


def test_quality_measures(docs):
    got = quality.verdicts(docs).collect()
    key = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    assert sorted((str(r.doc_id), *key(r)) for r in got) == sorted((str(t[0]), *measures(t[1])) for t in TEXTS)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_ablations(docs):
    book = quality.ledger(docs).cache()
    masks = [r.failures & quality.mask_of(quality.CURRENT) for r in book.collect()]
    for r in quality.ablations(book).collect():
        bit = 1 << [n for n, _ in quality.rules()].index(r.rule)
        assert r.n_failed == sum(bool(m & bit) for m in masks) and r.n_only == sum(m == bit for m in masks)


def test_raking_meets_marginals(spark):
    rows = [(i, "w " * (1 + i % 50), ("en", "de")[i % 2], ("a", "b", "c")[i % 3]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    goals = {
        "lang": spark.createDataFrame([("en", 0.7), ("de", 0.3)], "lang string, target double"),
        "source": spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0), ("zz", 9.0)], "source string, target double"),
    }
    got = mixing.mix(docs, keep=0.5, targets=goals).collect()
    total = sum(r.n_tokens for r in got)
    expected = sum(r.n_tokens * r.probability for r in got)
    assert abs(expected - 0.5 * total) < 1e-6 * total
    mass = sum(r.n_tokens * r.weight for r in got)
    for margin, value, share in (("lang", "en", 0.7), ("source", "a", 0.5), ("source", "c", 0.2)):
        assert abs(sum(r.n_tokens * r.weight for r in got if r[margin] == value) / mass - share) < 1e-4
    sampled = sum(r.n_tokens for r in got if r.sampled)
    assert abs(sampled - expected) < 0.05 * total


def test_mixing_awkward_rows(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.probability <= 1 for r in got)


@pytest.mark.parametrize("op", [exact_dedup.groups, sharding.shard, quality.verdicts, mixing.mix])
def test_empty_table(docs, op):
    assert op(docs.limit(0)).count() == 0


def test_expected_sample_meets_marginals(spark):
    # Raked weights reach 1 / keep in the cell (en, a), which gives all it has; the others make up for it.
    rows = [(i, "w " * 20, ("en", "de")[i % 2], ("a", "b", "c")[i % 3]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    goals = {
        "lang": spark.createDataFrame([("en", 0.7), ("de", 0.3)], "lang string, target double"),
        "source": spark.createDataFrame([("a", 0.55), ("b", 0.3), ("c", 0.15)], "source string, target double"),
    }
    mixed = mixing.mix(docs, keep=0.5, targets=goals).cache()
    report = {(r.margin, r.value): r for r in mixing.marginal_report(mixed).collect()}
    for margin, value, share in (("lang", "en", 0.7), ("source", "a", 0.55), ("source", "b", 0.3), ("source", "c", 0.15)):
        r = report[margin, value]
        assert abs(r.raked - share) < 1e-4 and abs(r.expected - share) < 1e-4 and abs(r.drawn - share) < 0.03
    assert abs(mixed.agg(F.sum(F.col("n_tokens") * F.col("probability"))).first()[0] - 60_000) < 0.1
    assert mixed.agg(F.max("probability")).first()[0] > 1 - 1e-9


def test_default_targets_are_met(spark):
    """At the defaults the expected sample has the raked shares of every value, small ones included."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rare = docs.limit(3).selectExpr("doc_id + 1000000 AS doc_id", "'# % & # % &' AS text", "'xx' AS lang", "'rare' AS source", "n_chars")
    for keep in (0.5, 0.9, 1.0):
        report = mixing.marginal_report(mixing.mix(docs.unionByName(rare), keep=keep)).collect()
        assert max(abs(r.raked - r.expected) for r in report) < 1e-4
        if keep < 1:
            assert all(r.raked > r.present for r in report if r.value in ("rare", "xx"))
