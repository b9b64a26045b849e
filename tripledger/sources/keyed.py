"""Tables with a key, merged by rewriting only the files that hold a key that comes in.

A table is a folder of Parquet files, none of which is ever changed, and numbered manifests: for each file its partition, its rows and its
first and last key. A version counts once its manifest is complete; a reader takes the files that it names. A merge finds
files in two steps: a join of the incoming keys with the manifest, by partition and key range, and a read of the key columns of those files,
semi-joined with the incoming keys. Files with a match are read, merged and written anew; all others stay where they are, named by the next manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripledger.sources import folders

FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Merged:
    """What a merge did: files of the version before, those rewritten, those written, and rows that came in."""

    version: int
    files_before: int
    rewritten: int
    written: int
    rows_in: int

    @property
    def kept(self) -> int:
        return self.files_before - self.rewritten


class KeyedTable:
    """key: the columns that name a row, ``partition`` among them, which splits the table into folders."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], partition: str, file_rows: int = FILE_ROWS):
        if partition not in key:
            raise ValueError("the partition is part of the key")
        self.spark, self.root, self.partition, self.file_rows = spark, root.rstrip("/"), partition, file_rows
        self.key = [partition, *(k for k in key if k != partition)]

    def _lower(self) -> Column:
        return F.struct(*self.key)

    def version(self) -> int | None:
        return folders.newest(self.spark, f"{self.root}/_manifests")

    def manifest(self, version: int | None = None) -> DataFrame:
        """file, the partition's value, n_rows, first and last key, and the table's schema, of a version, the newest if none is given."""
        version = self.version() if version is None else version
        if version is None:
            raise ValueError(f"no table in {self.root}")
        return self.spark.read.parquet(f"{self.root}/_manifests/v={version:08d}")

    def _files(self, files: list[str], schema: str) -> DataFrame:
        """Rows of files by the schema they were written with, the partition's type included, which their folders' names don't tell."""
        kept = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kept).option("basePath", f"{self.root}/data").parquet(*files).select(*kept.names)

    def read(self, partitions: list[str] | None = None, version: int | None = None) -> DataFrame:
        """A version's rows; with partitions, only files of those are named to the reader."""
        files = self.manifest(version)
        if partitions is not None:
            files = files.where(F.col(self.partition).cast("string").isin(partitions))
        names = [r.file for r in files.select("file").collect()]
        any_file = self.manifest(version).select("file", "schema").first()
        return self._files(names, any_file.schema) if names else self._files([any_file.file], any_file.schema).limit(0)

    def write(self, rows: DataFrame) -> Merged:
        """The table's first version, or a new one that holds these rows only. rows: one for each key."""
        before = self.version()
        n_before = 0 if before is None else self.manifest(before).count()
        entries, n = self._written(rows, rows.count())
        return Merged(self._commit(entries, before), n_before, n_before, entries.count(), n)

    def merge(self, incoming: DataFrame, resolve: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> Merged:
        """resolve(stored, incoming, key): the rows that stand for the rewritten files' rows and the incoming ones, such as mart.upsert.

        incoming has one row for each key; without rows nothing is written. Doing a merge twice rewrites the same files' successors.
        """
        before = self.version()
        manifest = self.manifest(before)
        any_file = manifest.select("file", "schema").first()
        coming = incoming.select(*self.key).distinct()
        near = manifest.alias("m").join(coming.select(F.col(self.partition), self._lower().alias("k")).alias("i"), self.partition)
        names = [r.file for r in near.where("k BETWEEN first AND last").select("file").distinct().collect()]
        if names:
            # Only the key columns of files that may hold an incoming key are read here.
            keys = self._files(names, any_file.schema).select(*self.key, F.input_file_name().alias("file"))
            names = [r.file for r in keys.join(coming, self.key, "left_semi").select("file").distinct().collect()]
        n_in = incoming.count()
        if not n_in:
            return Merged(before, manifest.count(), 0, 0, 0)
        known = {same_name(r.file): r for r in manifest.select("file", "n_rows").collect()}
        touched = [known[same_name(n)] for n in names]
        # Where no file holds an incoming key, all rows are new; an empty frame of the table's columns stands for the stored ones.
        stored = self._files([t.file for t in touched], any_file.schema) if touched else self._files([any_file.file], any_file.schema).limit(0)
        entries, _ = self._written(resolve(stored, incoming, self.key), sum(t.n_rows for t in touched) + n_in)
        stays = manifest.where(~F.col("file").isin([t.file for t in touched])) if touched else manifest
        return Merged(self._commit(stays.select(entries.columns).unionByName(entries), before), len(known), len(touched), entries.count(), n_in)

    def _written(self, rows: DataFrame, n: int) -> tuple[DataFrame, int]:
        """New files, sorted into ranges of the key, about file_rows rows in each; their manifest entries."""
        target = f"{self.root}/data/_write={uuid.uuid4().hex}"
        rows.repartitionByRange(max(1, -(-n // self.file_rows)), *self.key).sortWithinPartitions(*self.key).write.partitionBy(self.partition).option("maxRecordsPerFile", self.file_rows).parquet(target)
        if not folders.matching(self.spark, f"{target}/{self.partition}=*"):
            raise ValueError("a table needs rows")
        found = self._files([target], rows.schema.json())
        k = self._lower()
        entries = found.select(*self.key, F.input_file_name().alias("file")).groupBy("file", self.partition).agg(F.count(F.lit(1)).alias("n_rows"), F.min(k).alias("first"), F.max(k).alias("last"))
        return entries.withColumn("schema", F.lit(rows.schema.json())), n

    def _commit(self, entries: DataFrame, before: int | None) -> int:
        """The next manifest; where another writer has taken its number, this fails and the table stays as that one left it."""
        version = 0 if before is None else before + 1
        entries.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/_manifests/v={version:08d}")
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Drops manifests before the newest ``keep`` and the files that none of those names; the number of files."""
        newest = self.version()
        versions = range(max(0, newest - keep + 1), newest + 1)
        named = {same_name(r.file) for v in versions for r in self.manifest(v).select("file").collect()}
        for name in folders.matching(self.spark, f"{self.root}/_manifests/v=*"):
            if int(name.rsplit("=", 1)[1]) < versions[0]:
                folders.drop(self.spark, name)
        files = folders.matching(self.spark, f"{self.root}/data/_write=*/{self.partition}=*/*.parquet")
        return sum(folders.drop(self.spark, f) for f in files if same_name(f) not in named)


def same_name(file: str) -> str:
    """The part of a file's name that is the same however its file system is written."""
    return "/".join(file.rsplit("/", 3)[-3:])
