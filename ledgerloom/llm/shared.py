"""Small helpers that several training-data operators use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that separates words: space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables written to the shared folder so that lineage is cut; ``drop`` removes those no result reads any more."""

    def __init__(self, spark, purpose: str):
        self.spark = spark
        self.base = shared_dir(spark, purpose)
        self.count = 0

    def write(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        """``df`` as a written table. Re-reading it costs a scan; recomputing it after a lost executor costs nothing."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path, compression=compression)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def row_keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, Column]:
    """``docs`` and a key of its rows that is the same in every scan: the file and the place in it.

    Numbers given at run time would depend on how a scan is split, which changes with the executors there are. What is no
    plain scan of Parquet files is written first.
    """

    def key(df: DataFrame) -> Column:
        place = df.metadataColumn("_metadata")
        return F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"))

    try:
        docs.select(key(docs))
    except AnalysisException:
        docs = scratch.write(docs)
    return docs, key(docs)


def rows_at(docs: DataFrame, key: Column, places: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is among ``places._row``, with all their columns."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), key.alias("_row"))
    return packed.join(places, "_row", "left_semi").select("_doc.*")


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else. ``lower`` does that alone only where every character is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Characters of text that a Python worker holds as objects at a time; one longer text makes a slice of its own.
SLICE_BYTES = 2_000_000


def slices(batch: pa.RecordBatch, key: int = 0, text: int = 1) -> Iterator[tuple[pa.Array, list]]:
    """Runs of rows of a batch with a bounded amount of text: the key column and the texts as Python strings."""
    keys, texts = batch.column(key), batch.column(text)
    sizes = pc.binary_length(texts).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        held += size or 0
        if held >= SLICE_BYTES or i + 1 == len(sizes):
            yield keys[start : i + 1], texts[start : i + 1].to_pylist()
            start, held = i + 1, 0
