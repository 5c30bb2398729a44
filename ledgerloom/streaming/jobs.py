"""Structured Streaming jobs. Each function builds a streaming DataFrame or a foreachBatch body; ``run_available`` and
``run_batches`` drive one.

A job continues where it stopped when it is started again with the same checkpoint folder. Bodies keep their tables by
batch and read only what earlier batches wrote, so a batch that is tried again gives the same result. State is bounded
by age wherever the rules forget by age.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ledgerloom.operators import reconcile
from ledgerloom.session import materialize, shared_dir
from ledgerloom.sources.versions import VersionedTable

VERDICT = (
    "kind string, key string, course string, title string, date date, start_time string, end_time string, all_day boolean, site string, pos long, "
    "old_date date, old_times array<string>, n long"
)


Body = Callable[[DataFrame, int], None]


def file_stream(spark: SparkSession, folder: str, name: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """A parquet folder, or one file of it, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(folder)


def staged_files(parts: list[DataFrame], folder: str) -> str:
    """Write each part as one file of a folder, in order, for a stream that reads a file at a time."""
    for part in parts:
        part.repartition(1).write.mode("append").parquet(folder)  # the scan before it stays with all tasks
    return folder


def run_parts(parts: list[DataFrame], body: Body, purpose: str, folder: str | None = None, checkpoint: str | None = None) -> None:
    """Write each part into the folder of a stream and run ``body`` over it as one batch, in order.

    A part is as many files as tasks wrote it, so none writes or reads all of it; the stream takes whatever is new.
    """
    spark = parts[0].sparkSession
    folder, checkpoint = folder or shared_dir(spark, f"{purpose}-in"), checkpoint or shared_dir(spark, f"{purpose}-checkpoint")
    for part in parts:
        part.write.mode("append").parquet(folder)
        run_batches(file_stream(spark, folder, "*.parquet", part.schema), body, purpose, checkpoint=checkpoint)


EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def with_clock(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need an instant: zone-less times are read as UTC, at the edge of the stream only."""
    return events.withColumn(column, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {EPOCH}, {column}))"))


def wall_time(instant: str) -> str:
    """SQL text: the zone-less UTC time of an instant, whatever the session's zone."""
    return f"timestampadd(MICROSECOND, unix_micros({instant}), {EPOCH})"


def run_available(stream: DataFrame, purpose: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run to the end of the input into a parquet table and read it back; new folders unless the caller names its own."""
    spark = stream.sparkSession
    out, checkpoint = out or shared_dir(spark, purpose), checkpoint or shared_dir(spark, f"{purpose}-checkpoint")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(
    stream: DataFrame, body: Body, purpose: str, mode: str = "append", checkpoint: str | None = None, interval: str | None = None
) -> StreamingQuery | None:
    """Run ``body(batch, batch_id)`` batch after batch: over the available input, or every ``interval`` until it is stopped.

    With an interval the running query is returned.
    """
    writer = stream.writeStream.foreachBatch(body).outputMode(mode)
    writer = writer.option("checkpointLocation", checkpoint or shared_dir(stream.sparkSession, f"{purpose}-checkpoint"))
    if interval:
        return writer.trigger(processingTime=interval).start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return None


def tolerant(body: Body, failures: str) -> Body:
    """``body`` that records a failed batch (batch, reason) below ``failures`` and lets the stream go on."""

    def guarded(batch: DataFrame, batch_id: int) -> None:
        try:
            body(batch, batch_id)
        except Exception as e:  # whatever ends one poll must not end the stream
            row = [(batch_id, f"{type(e).__name__}: {e}".splitlines()[0][:500])]
            batch.sparkSession.createDataFrame(row, "batch long, reason string").write.mode("overwrite").parquet(f"{failures}/batch={batch_id}")

    return guarded


# ------------------------------------------------------------------ polling and sinks

def poll_into(path: str, counters: dict[str, str], apply: Body) -> Body:
    """A foreachBatch body that runs ``apply`` on a batch and writes one status per poll; the batch id is the run id.

    ``counters`` (name, SQL aggregate) are observed while ``apply`` reads the batch, so nothing is read a second time;
    ``apply`` must run the batch it is given. A poll that fails is a finished poll: its status says why and repeats the last
    counters, and the stream goes on. The status of a run overwrites itself, so a batch that is tried again leaves one.
    """
    schema = StructType([StructField("run_id", LongType()), StructField("ok", BooleanType()), *(StructField(c, LongType()) for c in counters), StructField("error", StringType())])

    def body(batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, Observation()
        try:
            apply(batch.observe(seen, *[F.expr(f"cast({e} AS bigint)").alias(c) for c, e in counters.items()]), batch_id)
            values, error = [seen.get[c] for c in counters], None
        except Exception as e:  # whatever ends one poll must not end the stream
            last = spark.read.schema(schema).parquet(f"{path}/run={batch_id - 1}").first() if batch_id else None
            values, error = [last[c] if last else 0 for c in counters], f"{type(e).__name__}: {e}".splitlines()[0][:500]
        spark.createDataFrame([(batch_id, error is None, *values, error)], schema).write.mode("overwrite").parquet(f"{path}/run={batch_id}")

    return body


SEEN_BUCKETS = 64


def seen_table(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> VersionedTable:
    """A table of keys marked as seen, dealt out to buckets by hash."""
    return VersionedTable(spark, path, StructType([*(schema[k] for k in keys), StructField("bucket", IntegerType())]), ["bucket"])


def unseen_into(path: str, seen: VersionedTable, keys: list[str], mark: bool = True, buckets: int = SEEN_BUCKETS) -> Body:
    """Write items whose keys are not marked as seen, and mark them; without ``mark`` they stay new, as unread mail does.

    Only buckets the batch's keys fall into are read, and only those that get new keys are written again, each as one run of
    sorted keys. Batch n makes version n of the table, so a batch that is tried again gives the same result.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = batch.dropDuplicates(keys).withColumn("bucket", F.expr(f"cast(pmod(xxhash64({', '.join(keys)}), {buckets}) AS int)"))
        found.write.mode("overwrite").parquet(f"{path}/found/batch={batch_id}")
        found = spark.read.schema(found.schema).parquet(f"{path}/found/batch={batch_id}")
        touched = [r.bucket for r in found.select("bucket").distinct().collect()]
        known = [v for v in seen.versions() if v < batch_id]
        marks = seen.read(known[-1] if known else None) if known else spark.createDataFrame([], seen.schema)
        marks = marks.where(F.col("bucket").isin(touched))
        fresh = found.join(marks, [*keys, "bucket"], "left_anti")
        fresh.drop("bucket").write.mode("overwrite").parquet(f"{path}/fresh/batch={batch_id}")
        if mark:
            new = spark.read.schema(batch.schema).parquet(f"{path}/fresh/batch={batch_id}").select(*keys)
            new = new.withColumn("bucket", F.expr(f"cast(pmod(xxhash64({', '.join(keys)}), {buckets}) AS int)"))
            grown = [r.bucket for r in new.select("bucket").distinct().collect()]
            rows = marks.where(F.col("bucket").isin(grown)).unionByName(new).repartition("bucket").sortWithinPartitions("bucket", *keys)
            seen.commit(batch_id, rows, [(b,) for b in grown])

    return body


def unseen_items(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All items written as new, with the batch that brought them."""
    fields = StructType([*schema, StructField("batch", LongType())])
    return spark.read.schema(fields).option("basePath", f"{path}/fresh").parquet(f"{path}/fresh")


def reconcile_into(table: VersionedTable, out: str, today: str, new_id: str, buckets: int = 1) -> Body:
    """A foreachBatch body that judges a batch against the table, applies what it finds and commits the next version.

    The table holds (id, course, title, date, start_time, end_time, all_day, source, bucket) by source and bucket of the
    course. Where it also holds what titles are compared by (``reconcile.SIGNED``), stored titles are never taken apart again.
    Rows that no item of the batch may name pass by everything but the commit. Verdicts go below ``out`` by batch. Only buckets
    of changed courses are written again. A batch that is tried again after its commit changes nothing; one that broke off
    before is judged against the same version as the first time. Version 0 is the caller's; batch n makes version n + 1.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        if batch_id + 1 in table.versions():
            return
        spark = batch.sparkSession
        stored = table.read().drop("bucket")
        items = materialize(reconcile.signed(batch), "pulled-signed")
        near, far = reconcile.met_by(stored, items)
        found = reconcile.reconcile(items, near, today, reconcile.platform_slots(stored))
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        verdicts = spark.read.schema(VERDICT).parquet(f"{out}/batch={batch_id}")
        changes = verdicts.where("kind <> 'present'")
        in_bucket = F.expr(f"cast(pmod(hash(course), {buckets}) AS int)")
        touched = [("csv", r.bucket) for r in changes.select(in_bucket.alias("bucket")).distinct().collect()]
        here = [b for _, b in touched]
        near, far = (rows.where("source = 'csv'").where(in_bucket.isin(here)) if here else rows.limit(0) for rows in (near, far))
        # What is new or moved may name fewer rows than what was pulled.
        mine, spared = reconcile.met_by(near, changes)
        after, _ = reconcile.apply_changes(mine, changes, new_id)
        after = after.unionByName(spared.select(*after.columns)).unionByName(far.select(*after.columns))
        table.commit(batch_id + 1, after.withColumn("bucket", in_bucket), touched)

    return body


# ------------------------------------------------------------------ stateful operators

def index_into(path: str, chunk: Callable[[DataFrame], DataFrame], schema: StructType, buckets: int = SEEN_BUCKETS) -> Body:
    """Keep an index of files (collection, path, mtime, size, text): only new and changed files are chunked.

    The manifest says for every file which batch chunked it; it is a versioned table in buckets of paths, of which a batch
    writes those again in which files changed. ``chunks/batch=N`` holds the chunks of a batch, ``report/batch=N`` what it
    scanned, indexed and added, observed while the chunks are written. Chunks of a file's earlier version are left behind by
    the manifest, and so are those of a batch that broke off before its manifest: the next run chunks these files again.
    """
    facts = ["path", "mtime", "size"]

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        manifest = index_manifest(spark, path, schema)
        known_version = [v for v in manifest.versions() if v < batch_id]
        known = manifest.read(known_version[-1]) if known_version else spark.createDataFrame([], manifest.schema)
        scanned, indexed, added = (Observation() for _ in range(3))
        one = lambda name: F.count(F.lit(1)).alias(name)
        newest = batch.groupBy("path").agg(F.max("mtime").alias("mtime"))
        files = batch.join(newest, ["path", "mtime"]).dropDuplicates(["path"]).observe(scanned, one("n"))
        changed = files.join(known.select(*facts), facts, "left_anti").observe(indexed, one("n"))
        changed.write.mode("overwrite").parquet(f"{path}/changed/batch={batch_id}")
        changed = spark.read.schema(files.schema).parquet(f"{path}/changed/batch={batch_id}")
        chunk(changed).observe(added, one("n")).write.mode("overwrite").parquet(f"{path}/chunks/batch={batch_id}")
        counts = [(batch_id, scanned.get["n"], indexed.get["n"], scanned.get["n"] - indexed.get["n"], added.get["n"])]
        spark.createDataFrame(counts, INDEX_REPORT).write.mode("overwrite").parquet(f"{path}/report/batch={batch_id}")
        mine = changed.select(*facts).withColumn("owner", F.lit(batch_id).cast("long")).withColumn("bucket", F.expr(f"cast(pmod(xxhash64(path), {buckets}) AS int)"))
        touched = [r.bucket for r in mine.select("bucket").distinct().collect()]
        kept = known.where(F.col("bucket").isin(touched)).join(mine.select("path"), "path", "left_anti")
        manifest.commit(batch_id, kept.select(*mine.columns).unionByName(mine), [(b,) for b in touched])

    return body


INDEX_REPORT = "batch long, scanned long, indexed long, skipped long, chunks_added long"


def index_manifest(spark: SparkSession, path: str, schema: StructType) -> VersionedTable:
    """(path, mtime, size, owner, bucket) of the files of an index."""
    fields = [*(schema[c] for c in ("path", "mtime", "size")), StructField("owner", LongType()), StructField("bucket", IntegerType())]
    return VersionedTable(spark, f"{path}/manifest", StructType(fields), ["bucket"])


def current_index(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The chunks that the newest manifest vouches for; ``schema`` is that of the files."""
    manifest = index_manifest(spark, path, schema).read().select(F.col("path").alias("source_path"), F.col("owner").alias("batch"))
    chunks = spark.read.option("basePath", f"{path}/chunks").parquet(f"{path}/chunks").withColumn("batch", F.col("batch").cast("long"))
    return chunks.join(manifest, ["source_path", "batch"], "left_semi").drop("batch")


def week_load(events: DataFrame, clock: str = "ts", delay: str = "1 day") -> DataFrame:
    """Rows per Monday week, emitted when the week has closed."""
    weeks = F.window(clock, "7 days", "7 days", "4 days")
    return events.withWatermark(clock, delay).groupBy(weeks).agg(F.count("*").alias("count")).selectExpr(
        f"cast({wall_time('window.start')} AS date) AS week_start", "count"
    )


def day_load(events: DataFrame, clock: str = "ts", delay: str = "1 day") -> DataFrame:
    """Rows per day, emitted when the day has closed."""
    return events.withWatermark(clock, delay).groupBy(F.window(clock, "1 day")).agg(F.count("*").alias("count")).selectExpr(
        f"cast({wall_time('window.start')} AS date) AS date", "count"
    )


def sessions(events: DataFrame, keys: list[str], gap: str, clock: str = "ts", delay: str = "1 day") -> DataFrame:
    """Stretches of activity per key as session windows, emitted when closed."""
    return events.withWatermark(clock, delay).groupBy(*keys, F.session_window(clock, gap)).agg(F.count("*").alias("n")).selectExpr(
        *keys, f"{wall_time('session_window.start')} AS start", f"{wall_time('session_window.end')} AS end", "n"
    )


def late_split(items: DataFrame, today: str, back: int = 30) -> DataFrame:
    """Flag items too old to act on: an explicit business rule beside the watermark."""
    return items.withColumn("late", F.expr(f"date < date_sub(date'{today}', {back})"))
