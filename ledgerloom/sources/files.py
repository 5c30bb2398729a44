"""File manifests and tolerant text decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# What a library folder holds and what is noise.
INCLUDE = ["**/*.pdf", "**/*.docx", "**/*.pptx", "**/*.md", "**/*.txt", "**/*.xlsx", "**/*.html", "**/*.htm"]
EXCLUDE = ["**/._*", "**/__MACOSX/**", "**/.DS_Store", "**/Thumbs.db"]


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; '*' crosses folders and a leading '**/' may match none."""
    p = pattern.lower()
    optional = p.startswith("**/")
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in re.sub(r"\*+", "*", p[3:] if optional else p))
    return f"^(.*/)?{body}$" if optional else f"^{body}$"


def matches_any(column: Column, patterns: list[str]) -> Column:
    cond = F.lit(False)
    for pattern in patterns:
        cond = cond | column.rlike(glob_regex(pattern))
    return cond


def file_manifest(
    spark: SparkSession, roots: list[str], collection: str, include: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """(collection, path, mtime, size) of files under ``roots``; file contents are never read."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
        .select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    )
    rel = F.lower(F.col("path"))
    for root in roots:
        rel = F.regexp_replace(rel, f"^(file:)?/*{re.escape(root.strip('/').lower())}/", "")
    kept = raw.withColumn("rel", rel)
    kept = kept.where(matches_any(F.col("rel"), include or INCLUDE)).where(
        ~matches_any(F.col("rel"), EXCLUDE if exclude is None else exclude)
    )
    return kept.dropDuplicates(["path"]).select(F.lit(collection).alias("collection"), "path", "mtime", "size")


# Byte-order marks, longest first, and the encodings they announce.
MARKS = (
    (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"),
)
HEAD = 4096


def decoded(content: bytes) -> str:
    """Text of a file: by its mark, else strict UTF-8, else UTF-16 of either order when full of NULs, else Latin-1.

    Of the two orders the one that puts most NULs into the high bytes is tried first, little-endian where they are even.
    Raises ValueError where none fits.
    """
    for mark, encoding in MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(encoding).lstrip("\ufeff")
    candidates = ["utf-8"]
    head = content[:HEAD]
    if 4 * head.count(0) > len(head):
        orders = ["utf-16-le", "utf-16-be"]
        candidates += orders[::-1] if head[::2].count(0) > head[1::2].count(0) else orders
    else:
        candidates.append("latin-1")
    for encoding in candidates:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("looks like UTF-16 but could not be decoded")


def decode_files(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``text`` and ``failure`` in place of their bytes; a file that cannot be read is a row with a reason."""
    place = files.columns.index(content)
    kept = [f for f in files.schema.fields if f.name != content]
    schema = StructType([*kept, StructField("text", StringType()), StructField("failure", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, failures = [], []
            for value in batch.column(place):
                text = failure = None
                try:
                    text = decoded(value.as_py()) if value.is_valid else None
                except ValueError as e:
                    failure = str(e).splitlines()[0] if not isinstance(e, UnicodeDecodeError) else f"not {e.encoding}: {e.reason}"
                texts.append(text)
                failures.append(failure)
            others = [batch.column(i) for i in range(batch.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string()), pa.array(failures, pa.string())], names=schema.names)

    return files.mapInArrow(run, schema)
