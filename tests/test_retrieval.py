"""Search, floors, gate, budgets and the vector table on small fixtures."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions.slices import mapped, slices
from ledgerloom.operators import corpus as C
from ledgerloom.operators import retrieval as R
from ledgerloom.operators import vectors as V


def random_space(spark, n, q, hot=0.0, seed=1):
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(n, 8))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    names = ["hot" if rng.random() < hot else f"c{i % 5}" for i in range(n)]
    asks = rng.normal(size=(q, 8))
    asks /= np.linalg.norm(asks, axis=1, keepdims=True)
    chunks = spark.createDataFrame([(i, names[i], vecs[i].tolist()) for i in range(n)], "chunk_id long, collection string, embedding array<double>")
    questions = spark.createDataFrame([(i, asks[i].tolist()) for i in range(q)], "question_id long, qvec array<double>")
    return questions, chunks, asks, vecs, names


def brute(asks, vecs, names, k, floor):
    out = set()
    for q, ask in enumerate(asks):
        for name in set(names):
            scored = sorted((-float(np.round(ask @ vecs[i], 12)), i) for i in range(len(vecs)) if names[i] == name)
            out |= {(q, name, i) for s, i in scored[:k] if -s >= floor}
    return out


@pytest.mark.parametrize("limit", [V.BROADCAST_BYTES, 300, 0])
@pytest.mark.parametrize(("hot", "adaptive"), [(0.0, "true"), (0.5, "false")])
def test_top_k_equals_brute_force(spark, limit, hot, adaptive, monkeypatch):
    monkeypatch.setattr(V, "HELD_ROWS", 40)
    monkeypatch.setattr(V, "SCORE_CELLS", 64)
    settings = {
        "spark.sql.adaptive.enabled": adaptive, "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "17",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        questions, chunks, asks, vecs, names = random_space(spark, 300, 9, hot)
        got = V.top_k(questions, chunks.repartition(7), 4, 0.2, broadcast_bytes=limit).collect()
        assert len(got) == len({(r.question_id, r.collection, r.chunk_id) for r in got})
        assert {(r.question_id, r.collection, r.chunk_id) for r in got} == brute(asks, vecs, names, 4, 0.2)
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_partial_hits_stay_near_the_result(spark):
    chunks = spark.range(20_000).selectExpr("id AS chunk_id", "concat('c', id % 2000) AS collection", "array(sin(id), cos(id)) AS embedding").repartition(4)
    questions = spark.range(5).selectExpr("id AS question_id", "'all' AS scope", "array(sin(id), cos(id)) AS qvec")
    assert V.partial_hits(questions, chunks, 2, -1.0).count() <= 4 * 5 * 2000 * 2


@pytest.mark.parametrize("limit", [V.BROADCAST_BYTES, 400])
def test_many_questions_meet_chunks_laid_by_collection(spark, monkeypatch, limit):
    met, plain = [], V.partial_hits
    monkeypatch.setattr(V, "FEW_QUESTIONS", 5, raising=False)
    monkeypatch.setattr(V, "partial_hits", lambda q, c, k, floor: met.append(c) or plain(q, c, k, floor))
    questions, chunks, asks, vecs, names = random_space(spark, 300, 9)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = V.top_k(questions, chunks.repartition(7), 4, 0.2, broadcast_bytes=limit)
        assert {(r.question_id, r.collection, r.chunk_id) for r in got.collect()} == brute(asks, vecs, names, 4, 0.2)
        pairs = met[0].select(F.input_file_name().alias("file"), "collection").distinct()
        files = pairs.select("file").where("file <> ''").distinct().count()
        assert files > 1 and pairs.count() < files + 5  # five collections
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scores_that_single_precision_cannot_tell_apart(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    vecs = base + rng.normal(size=(200, 16)) * 1e-8 * rng.integers(0, 2, (200, 1))
    names = [f"c{i % 3}" for i in range(200)]
    asks = np.stack([base, -base, base * 1e-3, rng.normal(size=16) * 1e16, np.zeros(16)])
    for n, space in ((5, 1.0), (5, 1e16)):
        rows = [(i, names[i], (vecs[i] * space).tolist()) for i in range(200)]
        chunks = spark.createDataFrame(rows, "chunk_id long, collection string, embedding array<double>").repartition(3)
        sides = (np.arange(n), np.array(["all"] * n, dtype=object), asks)
        best, asked = V._Best(4), V._Questions(sides)
        got = chunks.toArrow().sort_by("chunk_id")
        for at in range(0, 200, 60):
            some = got.slice(at, 60)
            V._block_hits(asked, some["chunk_id"].to_numpy(), np.array(some["collection"].to_pylist(), dtype=object), V._matrix(some["embedding"]), best, -1e300)
        found = {(q, c, i) for b in best.drain() for q, c, i in zip(*(b.column(x).to_pylist() for x in range(3)))}
        want = set()
        for q, ask in enumerate(asks):
            exact = np.round(np.einsum("ij,ij->i", np.broadcast_to(ask, vecs.shape), vecs * space), 12)
            for name in set(names):
                mine = sorted((-exact[i], i) for i in range(200) if names[i] == name)
                want |= {(q, name, i) for _, i in mine[:4]}
        assert found == want


def test_copies_do_not_crowd_a_block(spark):
    vecs = np.repeat(np.eye(4), 500, axis=0)
    kept = V._first_copies(np.arange(2000)[::-1].copy(), vecs, 2)
    assert sorted(np.arange(2000)[::-1][kept]) == [0, 1, 500, 501, 1000, 1001, 1500, 1501]


def test_copies_tie_by_id_and_scope_limits(spark):
    chunks = spark.createDataFrame([(i, "a" if i < 6 else "b", [1.0, 0.0]) for i in range(8)], "chunk_id long, collection string, embedding array<double>")
    questions = spark.createDataFrame([(1, "all", [1.0, 0.0]), (2, "b", [1.0, 0.0])], "question_id long, scope string, qvec array<double>")
    got = {(r.question_id, r.chunk_id) for r in V.top_k(questions, chunks.repartition(4), 2, 1.0).collect()}
    assert got == {(1, 0), (1, 1), (1, 6), (1, 7), (2, 6), (2, 7)}


def test_sparse_and_dense_embedding_agree(spark):
    docs = spark.createDataFrame([(1, "The cat, the CAT (sat)!"), (2, ""), (3, "\"quoted\" a.b")], "id long, text string")
    dense = {r.id: r.embedding for r in V.embed_with(docs).collect()}
    sparse = {i: [0.0] * V.BUCKETS for i in (1, 2, 3)}
    for r in V.hashed_embedding(docs, "id").collect():
        sparse[r.id][r.bucket] = r.weight
    for i in (1, 2, 3):
        assert dense[i] == pytest.approx(sparse[i])


def test_gate_levels(spark):
    hits = spark.createDataFrame([(1, "open"), (2, "open"), (2, "guarded"), (3, "guarded"), (3, "closed"), (4, "unlisted")], "question_id long, collection string")
    levels = spark.createDataFrame([("open", "full"), ("guarded", "explain_only"), ("closed", "off"), ("shut", "off")], "collection string, assist_level string")
    got = {r.question_id: (r.level, list(r.responsible)) for r in R.gate(hits, levels).collect()}
    assert got == {1: ("full", []), 2: ("explain_only", ["guarded"]), 3: ("blocked", ["closed"]), 4: ("full", [])}


def test_round_robin_skips_but_prefix_stops(spark):
    rows = [(1, "a", 1, 0.9, 60), (1, "a", 2, 0.8, 60), (1, "b", 3, 0.7, 30), (1, "b", 4, 0.6, 10)]
    hits = spark.createDataFrame(rows, "question_id long, collection string, chunk_id long, score double, cost int")
    kept = R.budget_round_robin(hits, 100, ["question_id"]).first().kept
    assert [k.chunk_id for k in kept] == [1, 3, 4]
    prefix = R.budget_prefix(hits, 100, ["question_id"]).collect()
    assert [r.chunk_id for r in prefix] == [1]
    assert [r.chunk_id for r in R.budget_prefix(hits, 5, ["question_id"]).collect()] == [1]


def prepared(spark, rows, scope="all", floor=0.6, soft=0.5, budget=8000, levels=None):
    vectors = spark.createDataFrame([(i, c, [s, (1 - s * s) ** 0.5]) for i, c, s, _ in rows], "chunk_id long, collection string, embedding array<double>")
    costs = spark.createDataFrame([(i, n) for i, _, _, n in rows], "chunk_id long, cost int")
    levels = spark.createDataFrame(levels or [("open", "full"), ("guarded", "explain_only"), ("closed", "off"), ("none", "full")], "collection string, assist_level string")
    questions = spark.createDataFrame([(1, scope, [1.0, 0.0])], "question_id long, scope string, qvec array<double>")
    return R.prepare_batch(questions, vectors, costs, levels, floor=floor, soft=soft, budget=budget).first()


def test_prepare_statuses(spark):
    rows = [(1, "open", 0.9, 100), (2, "guarded", 0.7, 100), (3, "closed", 0.4, 100)]
    r = prepared(spark, rows)
    assert (r.status, r.level, list(r.restricting), [c.chunk_id for c in r.cited], list(r.empty)) == ("answerable", "explain_only", ["guarded"], [1, 2], ["none"])
    assert "restricted by guarded" in r.notices[0] and not r.low_confidence
    assert prepared(spark, [*rows, (4, "closed", 0.8, 1)]).status == "blocked"
    assert prepared(spark, rows, scope="closed").status == "blocked"
    assert prepared(spark, rows, scope="none").status == "empty_index"
    assert prepared(spark, [(1, "open", 0.3, 1)]).status == "no_results"
    soft = prepared(spark, [(1, "open", 0.55, 1)])
    assert (soft.status, soft.low_confidence) == ("answerable", True)
    tight = prepared(spark, [(1, "open", 0.9, 900), (2, "open", 0.8, 900), (3, "guarded", 0.7, 50)], budget=1000)
    assert ([c.chunk_id for c in tight.cited], tight.dropped) == ([1, 3], 1)
    stop = prepared(spark, [(1, "open", 0.9, 900), (2, "open", 0.8, 900), (3, "open", 0.7, 50)], scope="open", budget=1000)
    assert ([c.chunk_id for c in stop.cited], stop.dropped) == ([1], 2)


def test_followups_across_blocks(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i} [3]") for i in range(20)]
    df = spark.createDataFrame(rows, "conversation_id long, turn long, role string, content string")
    want = {i: "\n".join([f"m{j}" for j in (i - 4, i - 2) if j >= 0] + [f"m{i} [3]"]) for i in range(0, 20, 2)}
    for width in (1, 3, 7, 100):
        got = R.prior_user_turns(df, width).collect()
        assert {r.turn: [p.turn for p in r.prior] for r in got} == {i: [j for j in (i - 2, i - 4) if j >= 0] for i in range(0, 20, 2)}
    assert {r.turn: r.query for r in R.followup_query(df).collect()} == want


def test_healed_store_equals_clean_run(spark):
    chunks = spark.createDataFrame([(i, f"h{i}", f"text {i}") for i in range(10)], "chunk_id long, content_hash string, text string")
    embed = lambda df: df.withColumn("embedding", F.expr("array(cast(chunk_id AS double), cast(length(text) AS double))"))
    clean = {tuple(r) for r in embed(chunks).selectExpr("chunk_id", "content_hash", "cast(embedding AS string)").collect()}
    broken = embed(chunks).selectExpr(
        "if(chunk_id = 3, 99, chunk_id) AS chunk_id", "CASE chunk_id WHEN 5 THEN 'old' WHEN 6 THEN null ELSE content_hash END AS content_hash", "embedding", "'m' AS model"
    )
    reasons = {r.chunk_id: r.reason for r in C.store_actions(chunks, broken).collect()}
    assert {k: v for k, v in reasons.items() if v != "current"} == {3: "missing", 99: "orphan", 5: "stale", 6: "unhashed"}
    healed = C.heal_store(chunks, broken, embed).selectExpr("chunk_id", "content_hash", "cast(embedding AS string)")
    assert {tuple(r) for r in healed.collect()} == clean
    with pytest.raises(Exception, match="out of step"):
        C.require_sound(chunks, broken, "m").collect()


def test_embedder_protocol(spark):
    """Questions take the model's prefix, and packing keeps within its window by its own tokens."""
    texts = spark.createDataFrame([(1, "alpha beta"), (2, None)], "id int, text string")
    asked = {r.id: r.embedding for r in V.embed_with(texts, lambda: V.HashingEmbedder("query: "), queries=True).collect()}
    plain = V.HashingEmbedder()
    assert asked[1] == pytest.approx(plain.embed_docs(["query: alpha beta"])[0]) and asked[2] == pytest.approx(plain.embed_docs(["query:"])[0])
    from ledgerloom.operators import chunking as K

    class Narrow(V.HashingEmbedder):
        max_tokens = 5

    rows = spark.createDataFrame([(["one two three.", "four five.", "six seven eight nine ten eleven twelve."],)], "s array<string>")
    chunks = rows.select(K.packer_for(Narrow)("s").alias("c")).first().c
    assert all(Narrow().count_tokens(c) <= 5 for c in chunks) and set(" ".join(chunks).split()) >= {"one", "twelve."}


def test_round_robin_over_many_collections(spark):
    """10,000 collections: the budget is spent best hit of each first, and no array holds a question's hits."""
    import random

    rng = random.Random(6)
    rows = [(q, f"c{c}", q * 1_000_000 + c * 10 + i, round(rng.random(), 3), rng.randint(1, 60)) for q in range(2) for c in range(10_000) for i in range(rng.randint(1, 3))]
    hits = spark.createDataFrame(rows, "question_id long, collection string, chunk_id long, score double, cost int").repartition(7)
    found = R.budget_round_robin(hits, 5000, ["question_id"])
    for r in found.collect():
        mine = [x for x in rows if x[0] == r.question_id]
        by = {}
        for x in sorted(mine, key=lambda x: (-x[3], x[2])):
            by.setdefault(x[1], []).append(x)
        offers = sorted((depth, -group[0][3], c, x[2], x[3], x[4]) for c, group in by.items() for depth, x in enumerate(group))
        kept, used = [], 0
        for _, _, c, chunk, score, cost in offers:
            if not kept or used + cost <= 5000:
                kept.append((c, chunk, score))
                used += cost
        assert r.offered == len(mine) and [tuple(k) for k in r.kept] == kept
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan


def test_vectors_of_chunks_are_made_once_for_all_blocks(spark):
    """More questions than one broadcast holds pass over the chunks block by block, but a chunk is embedded once."""
    made = spark.sparkContext.accumulator(0)

    def embed(batches):
        for rows in batches:
            made.add(rows.num_rows)
            yield rows

    schema = "chunk_id long, collection string, embedding array<double>"
    plain = spark.createDataFrame([(i, f"L{i % 3}", [float(i % 7), 1.0, float(i % 5)]) for i in range(90)], schema)
    questions = spark.createDataFrame([(q, [1.0, float(q), 0.5]) for q in range(40)], "question_id long, qvec array<double>")
    rows = sorted(V.top_k(questions, plain.mapInArrow(embed, schema), 2, broadcast_bytes=256).collect())
    assert made.value == 90
    assert rows == sorted(V.top_k(questions, plain, 2).collect()) and len(rows) == 40 * 3 * 2


def test_rows_become_objects_a_slice_at_a_time(spark):
    """A worker turns one slice of a batch into vectors at a time, whatever the size of the batch."""
    assert [len(s) for s in slices(pa.array(range(300)), 128)] == [128, 128, 44]
    upper = mapped(str.upper, StringType(), pa.string(), 3)
    rows = spark.range(0, 10, 1, 1).selectExpr("id", "if(id = 4, null, concat('a', id)) AS t").select("id", upper("t").alias("u")).collect()
    assert [r.u for r in rows] == [None if i == 4 else f"A{i}" for i in range(10)]
