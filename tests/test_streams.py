"""Streams that stop, go on and fail now and then."""

from datetime import date, datetime

import pytest

from ledgerloom.operators import chunking
from ledgerloom.session import shared_dir
from ledgerloom.streaming import jobs as J
from ledgerloom.streaming import state as K


def test_notifications_over_a_restart(spark):
    """A key notified on 1 January is silent on 20 March and due again on 20 July, also when the job was stopped meanwhile."""
    rows = [[("a", date(2024, 1, 1)), ("b", date(2024, 1, 5))], [("a", date(2024, 3, 20)), ("c", date(2024, 3, 20)), ("d", None)], [("a", date(2024, 7, 20)), ("a", date(2024, 7, 21)), ("b", date(2024, 4, 1))]]
    frames = [spark.createDataFrame(r, "k string, day date") for r in rows]
    folder, out, checkpoint = (shared_dir(spark, n) for n in ("in", "out", "check"))

    def run():
        stream = J.file_stream(spark, folder, "*.parquet", frames[0].schema, 1)
        return sorted((r.k, r.day) for r in K.run_stateful(K.due_notifications(stream, ["k"]), "notify", out, checkpoint).collect())

    J.staged_files(frames[:1], folder)
    first = [("a", date(2024, 1, 1)), ("b", date(2024, 1, 5))]
    assert run() == first
    J.staged_files(frames[1:], folder)
    assert run() == sorted([*first, ("c", date(2024, 3, 20)), ("a", date(2024, 7, 20))])
    assert run() == sorted([*first, ("c", date(2024, 3, 20)), ("a", date(2024, 7, 20))])


def test_a_failed_poll_is_recorded_and_passed_over(spark):
    frames = [spark.createDataFrame([(k,)], "k int") for k in range(3)]
    folder, failures = shared_dir(spark, "in"), shared_dir(spark, "failures")
    J.staged_files(frames, folder)
    seen = []

    def body(batch, batch_id):
        if batch.first().k == 1:
            raise ValueError("site is down")
        seen.append(batch.first().k)

    J.run_batches(J.file_stream(spark, folder, "*.parquet", frames[0].schema, 1), J.tolerant(body, failures), "poll")
    assert seen == [0, 2]
    assert [(r.batch, r.reason) for r in spark.read.option("recursiveFileLookup", "true").parquet(failures).collect()] == [(1, "ValueError: site is down")]


def test_interval_runs_until_stopped(spark):
    folder = J.staged_files([spark.createDataFrame([(1,)], "k int")], shared_dir(spark, "in"))
    seen = []
    stream = J.file_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema)
    query = J.run_batches(stream, lambda b, i: seen.append(b.count()), "poll", interval="1 second")
    query.processAllAvailable()
    query.stop()
    assert seen == [1]


def test_polls_observe_their_counters(spark):
    """A failed poll is a finished one: its number rises, its counters are the last ones."""
    frames = [spark.createDataFrame([(k, i) for i in range(k + 2)], "k int, i int") for k in range(4)]
    folder, status = (shared_dir(spark, n) for n in ("in", "status"))
    J.staged_files(frames, folder)

    def apply(batch, batch_id):
        if batch_id in (0, 2):
            raise ValueError("site is down")
        batch.write.format("noop").mode("overwrite").save()

    body = J.poll_into(status, {"items": "count(*)", "high": "sum(i)"}, apply)
    J.run_batches(J.file_stream(spark, folder, "*.parquet", frames[0].schema, 1), body, "poll")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(status).orderBy("run_id").collect()
    assert [tuple(r) for r in rows] == [
        (0, False, 0, 0, "ValueError: site is down"), (1, True, 3, 3, None), (2, False, 3, 3, "ValueError: site is down"), (3, True, 5, 10, None),
    ]


def test_seen_items_are_marked_once_and_a_batch_can_be_tried_again(spark):
    schema = spark.createDataFrame([], "id long, title string").schema
    frames = [spark.createDataFrame(r, schema) for r in ([(1, "a"), (2, "b"), (2, "b")], [(2, "b"), (3, "c")], [], [(1, "a"), (3, "c"), (4, "d")])]
    out = shared_dir(spark, "out")
    seen = J.seen_table(spark, shared_dir(spark, "seen"), schema, ["id"])
    body = J.unseen_into(out, seen, ["id"], buckets=3)
    for n, batch in enumerate(frames):
        body(batch, n)
        body(batch, n)
    assert sorted((r.id, r.batch) for r in J.unseen_items(spark, out, schema).collect()) == [(1, 0), (2, 0), (3, 1), (4, 3)]
    assert sorted(r.id for r in seen.read().collect()) == [1, 2, 3, 4]
    # Not marked, an item stays new.
    dry = shared_dir(spark, "dry")
    look = J.unseen_into(dry, J.seen_table(spark, shared_dir(spark, "unmarked"), schema, ["id"]), ["id"], mark=False)
    for n, batch in enumerate(frames[:2]):
        look(batch, n)
    assert sorted((r.id, r.batch) for r in J.unseen_items(spark, dry, schema).collect()) == [(1, 0), (2, 0), (2, 1), (3, 1)]


def test_an_interrupted_index_heals_on_the_next_run(spark, monkeypatch):
    """A batch that stops between its chunks and its manifest is chunked again; nothing is there twice."""
    schema = spark.createDataFrame([], "collection string, path string, mtime timestamp, size long, text string").schema
    day = lambda n: datetime(2024, 1, n)
    frames = [
        spark.createDataFrame([("c", "a.txt", day(1), 3, "One."), ("c", "b.txt", day(1), 3, "Two.")], schema),
        spark.createDataFrame([("c", "a.txt", day(2), 4, "One more."), ("c", "b.txt", day(1), 3, "Two."), ("c", "d.txt", day(1), 3, "Three.")], schema),
    ]
    out = shared_dir(spark, "index")
    body = J.index_into(out, chunking.chunk_files, schema, buckets=4)
    body(frames[0], 0)
    with monkeypatch.context() as m:
        m.setattr(J.VersionedTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("power loss")))
        with pytest.raises(OSError):
            body(frames[1], 1)
    assert sorted(r.text for r in J.current_index(spark, out, schema).collect()) == ["One.", "Two."]
    body(frames[1], 1)
    assert sorted(r.text for r in J.current_index(spark, out, schema).collect()) == ["One more.", "Three.", "Two."]
    report = spark.read.schema(J.INDEX_REPORT).option("recursiveFileLookup", "true").parquet(f"{out}/report").orderBy("batch").collect()
    assert [tuple(r) for r in report] == [(0, 2, 2, 0, 2), (1, 3, 2, 1, 2)]


def test_a_part_of_several_files_is_one_batch(spark):
    parts = [spark.range(k * 100, k * 100 + 50).repartition(5) for k in range(3)]
    folder, seen = shared_dir(spark, "parts"), []
    J.run_parts(parts, lambda batch, batch_id: seen.append((batch_id, sorted(r.id for r in batch.collect()))), "parts", folder)
    assert seen == [(k, list(range(k * 100, k * 100 + 50))) for k in range(3)]
    assert len(spark.read.parquet(folder).inputFiles()) > len(parts)
