"""A Parquet table that changes by whole partitions, one numbered commit after the other.

A commit writes the new rows of the partitions it replaces into a folder of its own and then one small manifest that says
for every partition which folder's rows hold. The manifest appears by a rename that never replaces a file, so a commit is
there whole or not at all, readers keep the version they began with, and a batch that is tried again, even while the first
attempt still writes, leaves one version. Partitions that a commit doesn't name keep their files. A manifest has one entry
per partition; it is read by the driver. Folders that no manifest names are left by attempts that broke off.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class VersionedTable:
    """``schema`` names all columns, ``partition`` those by which rows are replaced; their values are texts or whole numbers."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, partition: list[str]):
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, partition

    # -------------------------------------------------------------- manifests

    def _files(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the commits, oldest first."""
        _, where, fs = self._files(f"{self.path}/commits")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def owners(self, version: int | None = None) -> dict[tuple, str]:
        """Which folder holds each partition, at a version or now; its name begins with the batch that wrote it."""
        found = self.versions()
        if version is None:
            version = found[-1] if found else None
        elif version not in found:
            raise ValueError(f"no version {version} in {self.path}")
        if version is None:
            return {}
        text = self.spark.read.text(f"{self.path}/commits/{version:012d}.json", wholetext=True).first()[0]
        return {tuple(values): folder for *values, folder in json.loads(text)}

    def _publish(self, version: int, owners: dict[tuple, str]) -> None:
        """Rename a finished manifest into place; another writer's manifest of this number stays and counts."""
        jvm, target, fs = self._files(f"{self.path}/commits/{version:012d}.json")
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/drafts/{jvm.java.util.UUID.randomUUID()}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(sorted([*k, f] for k, f in owners.items())).encode()))
        out.close()
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, fs.makeQualified(target), options)

    # -------------------------------------------------------------- rows

    def _stored(self, folders: Iterable[str]) -> DataFrame:
        schema = StructType([*self.schema, StructField("folder_name", StringType())])
        paths = [f"{self.path}/data/folder_name={f}" for f in sorted(set(folders))]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows at a version, or the newest; an empty table before the first commit."""
        owners = self.owners(version)
        if not owners:
            return self.spark.createDataFrame([], self.schema)
        byfolder_name: dict[str, list[tuple]] = {}
        for values, folder in owners.items():
            byfolder_name.setdefault(folder, []).append(values)
        held = F.lit(False)
        for folder, values in byfolder_name.items():
            here = F.struct(*self.partition).isin([F.struct(*map(F.lit, v)) for v in values])
            if len(self.partition) == 1:
                here = F.col(self.partition[0]).isin([v for (v,) in values])
            held = held | ((F.col("folder_name") == folder) & here)
        return self._stored(byfolder_name).where(held).select(*self.schema.names)

    def commit(self, batch: int, rows: DataFrame, replaced: Iterable[tuple]) -> bool:
        """Let ``rows`` be all rows of the ``replaced`` partitions; False if this batch, or a later one, is committed already.

        Rows of other partitions are refused. A partition of which there are no rows is empty from now on.
        """
        before = self.versions()
        if before and before[-1] >= batch:
            return False
        replaced = {tuple(r) for r in replaced}
        owners = {k: f for k, f in self.owners().items() if k not in replaced}
        if replaced:
            folder = f"{batch:012d}-{uuid.uuid4().hex[:12]}"
            rows.select(*self.schema.names).write.partitionBy(*self.partition).parquet(f"{self.path}/data/folder_name={folder}")
            written = {tuple(r) for r in self._stored([folder]).select(*self.partition).distinct().collect()}
            if written - replaced:
                raise ValueError(f"rows of partitions that are not replaced: {sorted(written - replaced)[:5]}")
            owners |= dict.fromkeys(written, folder)
        self._publish(batch, owners)
        return True
