"""Keyed state: silence, forgetting by timers, late rows, restarts."""

import random
from datetime import date, timedelta

from ledgerloom.session import shared_dir
from ledgerloom.streaming import jobs as J
from ledgerloom.streaming import state as K

FIRST = date(2024, 1, 1)


def streamed(spark, frames, build, runs):
    """The output after all files, staged and run in as many runs."""
    folder, out, checkpoint = (shared_dir(spark, n) for n in ("in", "out", "check"))
    step = -(-len(frames) // runs)
    for at in range(0, len(frames), step):
        J.staged_files(frames[at : at + step], folder)
        stream = J.file_stream(spark, folder, "*.parquet", frames[0].schema, 1)
        found = K.run_stateful(build(stream), "state-test", out, checkpoint)
    return found


def accepted(batches, delay):
    """The rows that are not late, batch by batch; the day comes last in a row."""
    newest, out = None, []
    for rows in batches:
        out.append([r for r in rows if newest is None or r[-1] > newest - timedelta(days=delay)])
        newest = max([r[-1] for r in rows] + ([newest] if newest else []))
    return out


def random_batches(rng, n, keys):
    """Six files that move on in time, some rows of each arriving late."""
    return [
        [(rng.choice(keys), b * 1000 + i, rng.random() < 0.5, FIRST + timedelta(days=max(0, b * 40 + rng.randint(0, 60) - rng.choice((0, 0, 0, 70, 160))))) for i in range(n)]
        for b in range(6)
    ]


def test_notifications_with_late_rows(spark):
    batches = [[(k, d) for k, _, _, d in b] for b in random_batches(random.Random(1), 60, "abcde")]
    last, want = {}, []
    for rows in accepted(batches, 50):
        for k, d in sorted(set(rows)):
            if k not in last or (d - last[k]).days > 30:
                want.append((k, d))
                last[k] = d
    frames = [spark.createDataFrame(b, "k string, day date") for b in batches]
    for runs in (1, 3):
        found = streamed(spark, frames, lambda s: K.due_notifications(s, ["k"], keep_days=30, delay_days=50), runs)
        assert sorted((r.k, r.day) for r in found.collect()) == sorted(want)


def test_slot_changes_with_late_rows_and_forgetting(spark):
    batches = random_batches(random.Random(2), 40, "abc")
    known, want = {}, []
    for rows in accepted(batches, 50):
        for k, n, done, d in sorted(rows, key=lambda r: r[1]):
            old = known.get(k)
            silent = old is None or (d - old[2]).days > 20
            if not silent and n <= old[0]:
                continue
            if silent or done != old[1]:
                want.append((k, n, done, d))
            known[k] = (n, done, d)
    frames = [spark.createDataFrame(b, "k string, line_no long, done boolean, day date") for b in batches]
    found = streamed(spark, frames, lambda s: K.slot_changes(s, ["k"], ["done"], keep_days=20, delay_days=50), 2)
    assert sorted((r.k, r.line_no, r.done, r.day) for r in found.collect()) == sorted(want)


def test_state_is_gone_after_its_timer(spark):
    """Once the watermark has passed a key's time, the store holds the other keys only."""
    frames = [spark.createDataFrame(r, "k string, day date") for r in ([("old", FIRST)], [("new", FIRST + timedelta(days=200))], [("new", FIRST + timedelta(days=201))])]
    folder, out, checkpoint = (shared_dir(spark, n) for n in ("in", "out", "check"))
    J.staged_files(frames, folder)
    stream = J.file_stream(spark, folder, "*.parquet", frames[0].schema, 1)
    K.run_stateful(K.due_notifications(stream, ["k"]), "state-test", out, checkpoint)
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "remembered")
    with K.rocksdb(spark):
        assert [r.key[0] for r in reader.load().collect()] == ["new"]


def test_provider_comes_back(spark):
    before = spark.conf.get(K.PROVIDER, None)
    with K.rocksdb(spark):
        assert spark.conf.get(K.PROVIDER) == K.ROCKSDB
    assert spark.conf.get(K.PROVIDER, None) == before


def test_keys_in_buckets_are_due_as_single_ones_are(spark):
    """Buckets of several keys give the same days, over late rows and restarts, and forget the keys whose silence is over."""
    batches = [[(k, d) for k, _, _, d in b] for b in random_batches(random.Random(3), 60, "abcdefgh")]
    frames = [spark.createDataFrame(b, "k string, day date") for b in batches]
    want = streamed(spark, frames, lambda s: K.due_notifications(s, ["k"], keep_days=30, delay_days=50), 1).collect()
    for runs in (1, 3):
        found = streamed(spark, frames, lambda s: K.due_notifications(s, ["k"], keep_days=30, delay_days=50, buckets=3), runs).collect()
        assert sorted(found) == sorted(want) and want
    frames = [spark.createDataFrame(r, "k string, day date") for r in ([("old", FIRST)], [("new", FIRST + timedelta(days=200))], [("new", FIRST + timedelta(days=201))])]
    folder, out, checkpoint = (shared_dir(spark, n) for n in ("in", "out", "check"))
    J.staged_files(frames, folder)
    K.run_stateful(K.due_notifications(J.file_stream(spark, folder, "*.parquet", frames[0].schema, 1), ["k"], buckets=1), "state-test", out, checkpoint)
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last_days")
    with K.rocksdb(spark):
        assert [r.list_element.k for r in reader.load().collect()] == ["new"]
