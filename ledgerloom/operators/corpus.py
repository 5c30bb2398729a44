"""Incremental indexing: change detection, failures, status, and the upkeep of the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.chunking import ZERO_CHUNKS


# A file and its manifest row agree.
SAME = "old_size = size AND abs(unix_micros(cast(old_mtime AS timestamp)) - unix_micros(cast(mtime AS timestamp))) < 1"


def changed_files(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files whose size or modification time differs from the manifest, or that it lacks."""
    if force:
        return files
    old = manifest.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    return files.join(old, "path", "left").where(f"NOT coalesce({SAME}, false)").drop("old_size", "old_mtime")


def removed_files(manifest: DataFrame, files: DataFrame, unhealthy: DataFrame) -> DataFrame:
    """Manifest rows with no file left, except where a root of the collection could not be read."""
    return manifest.join(unhealthy.select("collection").distinct(), "collection", "left_anti").join(
        files.select("path"), "path", "left_anti"
    )


def zero_chunk_failures(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files that were read but gave no chunk."""
    return files.join(chunks.select(F.col("source_path").alias("path")), "path", "left_anti").select(
        "collection", "path", F.lit(ZERO_CHUNKS).alias("reason")
    )


def index_status(files: DataFrame, chunks: DataFrame, failures: DataFrame) -> DataFrame:
    """Per collection: files, chunks, failures. The failure rows themselves stay a table of their own."""
    f = files.groupBy("collection").agg(F.count("*").alias("doc_count"))
    c = chunks.groupBy("collection").agg(F.count("*").alias("chunk_count"))
    x = failures.groupBy("collection").agg(F.count("*").alias("failure_count"))
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("doc_count", "chunk_count", "failure_count")]
    return f.join(c, "collection", "full_outer").join(x, "collection", "full_outer").select("collection", *zero)


def index_report(files: DataFrame, manifest: DataFrame, failures: DataFrame, unhealthy: DataFrame) -> DataFrame:
    """Run counters per collection: scanned, skipped, indexed, removed, failed."""
    old = manifest.selectExpr("path", "collection AS old_collection", "size AS old_size", "mtime AS old_mtime", "true AS known")
    bad = failures.groupBy("path").agg(F.count("*").alias("n_failed"))
    gone = unhealthy.selectExpr("collection AS old_collection", "true AS unread").distinct()
    both = files.selectExpr("path", "collection", "size", "mtime", "true AS live").join(old, "path", "full_outer").join(bad, "path", "left")
    judged = both.join(gone, "old_collection", "left").selectExpr(
        "coalesce(collection, old_collection) AS collection", "live", "n_failed",
        f"live AND NOT coalesce({SAME}, false) AS changed", "live IS NULL AND unread IS NULL AS removed",
    )
    return judged.groupBy("collection").agg(
        F.expr("count_if(live) AS scanned"), F.expr("count_if(live AND NOT changed) AS skipped"),
        F.expr("count_if(changed) - coalesce(sum(n_failed) FILTER (WHERE changed), 0) AS indexed"),
        F.expr("count_if(removed) AS removed"), F.expr("coalesce(sum(n_failed) FILTER (WHERE changed), 0) AS failed"),
    ).where("scanned > 0 OR removed > 0")


# ------------------------------------------------------------------ vector table upkeep

def store_actions(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """What to do with every chunk and stored vector: keep, embed (missing or stale) or drop (orphan).

    A store row without a hash cannot be trusted and is embedded again.
    """
    old = store.select("chunk_id", F.col("content_hash").alias("stored_hash"), F.lit(True).alias("stored"))
    new = chunks.select("chunk_id", "content_hash", F.lit(True).alias("live"))
    return new.join(old, "chunk_id", "full_outer").selectExpr(
        "chunk_id",
        "CASE WHEN live IS NULL THEN 'drop' WHEN stored IS NULL THEN 'embed' WHEN stored_hash <=> content_hash THEN 'keep'"
        " ELSE 'embed' END AS action",
        "CASE WHEN live IS NULL THEN 'orphan' WHEN stored IS NULL THEN 'missing' WHEN stored_hash IS NULL THEN 'unhashed'"
        " WHEN stored_hash <> content_hash THEN 'stale' ELSE 'current' END AS reason",
    )


def heal_store(chunks: DataFrame, store: DataFrame, embed) -> DataFrame:
    """The vector table a clean run would give, embedding only missing and stale chunks.

    ``embed`` turns (chunk_id, content_hash, text) rows into (chunk_id, content_hash, embedding) rows.
    """
    keys = chunks.select("chunk_id", "content_hash")
    kept = store.select("chunk_id", "content_hash", "embedding").join(keys, ["chunk_id", "content_hash"], "left_semi")
    todo = chunks.select("chunk_id", "content_hash", "text").join(kept, ["chunk_id", "content_hash"], "left_anti")
    return kept.unionByName(embed(todo).select("chunk_id", "content_hash", "embedding"))


def store_integrity(chunks: DataFrame, store: DataFrame, model: str) -> DataFrame:
    """Counts of everything that would make a search cite the wrong source."""
    acts = store_actions(chunks, store).agg(
        *[F.expr(f"count_if(reason = '{r}')").alias(r) for r in ("missing", "stale", "orphan", "unhashed")]
    )
    wrong = store.agg(F.expr(f"count_if(NOT (model <=> '{model}')) AS wrong_model"))
    return acts.select("*", wrong.scalar().alias("wrong_model"))


def require_sound(chunks: DataFrame, store: DataFrame, model: str) -> DataFrame:
    """The same counts, failing the job when vectors are missing, stale or of another model."""
    checks = store_integrity(chunks, store, model)
    return checks.withColumn(
        "sound",
        F.expr("assert_true(missing = 0 AND stale = 0 AND wrong_model = 0, 'vector table is out of step with the chunks') IS NULL"),
    )


def chunk_vectors(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks with their vectors, by id and hash."""
    return chunks.join(store.select("chunk_id", "content_hash", "embedding"), ["chunk_id", "content_hash"])
