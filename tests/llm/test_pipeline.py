"""The pipeline stage by stage against brute force on a small table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import mixing, pieces, simhash
from tests.llm.test_native_ops import lowered
from tests.llm.test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = " ".join(rng.choices(words, k=rng.randint(30, 120)))
        toxic = i % 5 == 0
        if toxic:
            text += " you grubber and you snark, grubber."
        rows.append((i, text, ("en", "de")[i % 2], f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(100):
        t = rows[i * 3 + 1][1]
        rows.append((1000 + i, t.upper() if i % 2 else t, "en", "s0", len(t)))
        rows.append((2000 + i, t + " tail", "en", "s0", len(t) + 5))
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0), (3001, "", "en", "s1", 0), (None, "no id here at all", "en", "s1", 17)]
    folder = tmp_path_factory.mktemp("sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_stages(spark, sf_dir, tmp_path):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = before.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        old, new = before.collect(), after.collect()
        if name == "toxicity":
            want = [r for r in old if "grubber" not in (r.text or "").lower()]
            assert sorted(map(str, new)) == sorted(map(str, want))
        elif name == "exact_dedup":
            best = {}
            for r in old:
                key = lowered(r.text)
                if key not in best or (-1 if r.doc_id is None else r.doc_id) > (-1 if best[key] is None else best[key]):
                    best[key] = r.doc_id
            assert sorted((str(r.doc_id), lowered(r.text)) for r in new) == sorted((str(d), t) for t, d in best.items())
        elif name == "simhash_near_dedup":
            comp = plain_components([plain_fingerprint(r.text) for r in old])
            least = {}
            for r, c in zip(old, comp, strict=True):
                ids = least.setdefault(c, [])
                ids.append((r.doc_id is None, -1 if r.doc_id is None else r.doc_id))
            assert sorted(str(r.doc_id) for r in new) == sorted(str(min(v)[1]) if not min(v)[0] else "None" for v in least.values())
        elif name == "mixing":
            drawn = mixing.mix(before).where("sampled")
            assert sorted(str(r.doc_id) for r in new) == sorted(str(r.doc_id) for r in drawn.collect())
            assert 0.5 * len(old) < len(new) <= len(old)
        else:
            texts = {r.doc_id: r.text for r in pieces.decoded(after).collect()}
            assert texts == {r.doc_id: r.text for r in old} and all(r.lossless for r in new if r.ids is not None)
        if number + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == columns
        before = after
    assert corpus_pipeline.run(spark, sf_dir).exceptAll(before).count() == 0


def test_stage_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None and simhash.MAX_BITS == 4


def test_empty_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
