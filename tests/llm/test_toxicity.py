"""Toxic spans: exact marginals, held-out accuracy, awkward rows."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity

NAMES = [a + b for a in ("ta", "ro", "mi", "ke", "lu", "so", "ne", "pi") for b in ("lan", "dor", "vik", "mos", "ter", "gul")]


def sentence(rng, bad=()):
    words = [rng.choice(NAMES) for _ in range(rng.randint(4, 12))]
    for w in bad:
        words.insert(rng.randint(0, len(words)), w)
    return " ".join(words) + "."


def corpus(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        bad = [rng.choice(["grubber", "Snark", "slogg" + rng.choice(NAMES)]) for _ in range(rng.randint(1, 3))] if toxic else []
        text = "\n".join(sentence(rng, bad if k == 1 else ()) for k in range(4))
        out.append((i, text, int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(800)
    return toxicity.train([t for _, t, _ in rows], [y for *_, y in rows])


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 4, 3, 6])
    e, trans = rng.normal(0, 2, sizes.sum()), rng.normal(0, 1, (2, 2))
    got = toxicity.marginals(e, sizes, trans)
    at = 0
    for n in sizes:
        total = np.zeros(2)
        per = np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + i] * t for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in itertools.pairwise(tags)))
            total[0] += w
            per += w * np.array(tags)
        assert np.allclose(got[at : at + n], per / total[0])
        at += n


def test_held_out_accuracy_and_offsets(model):
    scorer = toxicity.Scorer(model)
    rows = corpus(200, seed=2)
    got = scorer([t for _, t, _ in rows])
    assert np.mean([(s >= 0.5) == y for (s, _), (*_, y) in zip(got, rows, strict=True)]) > 0.98
    for (_, spans), (_, text, y) in zip(got, rows, strict=True):
        assert bool(spans) == bool(y)
        assert all(text[a:b].lower().startswith(("grubber", "snark", "slogg")) for a, b, _ in spans)


def test_copies_do_not_make_markers():
    rows = corpus(400, seed=5)
    passage = "alpha betaword gammaword deltaword."
    texts = [t + (passage if y and i % 8 == 0 else "") for i, t, y in rows]
    words, ids, sizes, owner = toxicity.indexed(texts)
    marks = toxicity.markers(words, ids, sizes, np.repeat(np.array([y for *_, y in rows], bool)[owner], sizes))
    assert "=betaword" not in marks and "=grubber" in marks and "slogg" in marks


def test_tables(spark):
    rows = [(i, t, "s", 1.0) for i, t, _ in corpus(500)]
    rows += [(9001, None, "s", 0.0), (9002, "", "s", 0.0), (9003, "snark " * 40_000, "s", 0.0), (None, "snark you", "s", 0.0), (9002, "", "s", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, spans double")
    labels = spark.createDataFrame(
        [(i, y) for i, _, y in corpus(500)] + [(None, 1), (3, None), (77777, 1)], "doc_id long, toxic int"
    )
    fitted = toxicity.fit(docs, labels, sample=300)
    got = {r.doc_id: r for r in toxicity.scored(docs, fitted).collect()}
    assert got[9001].score == got[9002].score < 0.5 <= got[9003].score and len(got[9003].spans) == 40_000
    assert got[None].score >= 0.5
    kept = toxicity.clean_rows(docs, fitted)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, y in ((r[0], got[r[0]].score) for r in rows) if y < 0.5}
    assert toxicity.scored(docs.limit(0), fitted).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.scored(docs, None).agg(F.max("score")).first()[0] == 0.0


def test_generated_documents_held_out(spark):
    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("test tables are absent")
    from ledgerloom.llm.queries import op6_toxicity

    got = op6_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    both = got.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    right, n = both.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert n > 500 and right > 0.97
