"""Live views as runs of rows in levels, so that a read touches few folders however many batches have been written.

A batch adds a run to level 0. FAN runs of a level become one of the next, in which each key stands once; those of the last level become part of the base. So there
are at most FAN - 1 runs in each of the two levels, and the base. A manifest for each batch names the runs; a batch that is written again finds itself in the
newest manifest and does nothing, and one that failed half-way leaves runs that no manifest names, which it overwrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.sources import folders

FAN, BASE = 4, 2
MANIFEST = "level int, first bigint, last bigint, path string"

Combine = Callable[[DataFrame], DataFrame]


def newest_by(key: list[str]) -> Combine:
    """Of the rows of a key, that of the latest batch; a batch has one at most."""

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*")

    return combine


def summed_by(key: list[str], measures: list[str]) -> Combine:
    """Rows are changes, which add up; the batch is that of the last change."""

    def combine(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(*[F.sum(m).alias(m) for m in measures], F.max("batch").alias("batch")).select(*rows.columns)

    return combine


class LeveledView:
    """combine: from the rows of some runs, with their batch, to one row for each key, in any grouping of the runs."""

    def __init__(self, spark: SparkSession, root: str, combine: Combine, standing: str = "true"):
        """standing: a condition on rows that stand for something; others, such as removals, are forgotten once they are part of the base."""
        self.spark, self.root, self.combine, self.standing = spark, root.rstrip("/"), combine, standing

    def runs(self) -> list[tuple[int, int, int, str]]:
        """Level, first and last batch, and folder of each run that a read touches."""
        version = folders.newest(self.spark, f"{self.root}/_manifests")
        if version is None:
            return []
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifests/v={version:012d}").orderBy("first").collect()]

    def _rows(self, runs: list[tuple]) -> DataFrame:
        return self.combine(self.spark.read.parquet(*[r[3] for r in runs]))

    def add(self, rows: DataFrame, batch: int) -> None:
        before = folders.newest(self.spark, f"{self.root}/_manifests")
        if before is not None and before >= batch:
            # Nothing to write, but the state of the operators before this has to move on, which Spark insists upon.
            rows.write.format("noop").mode("overwrite").save()
            return
        runs = self.runs()
        runs.append(self._run(0, batch, batch, rows.withColumn("batch", F.lit(batch).cast("bigint"))))
        for level in range(BASE):
            full = [r for r in runs if r[0] == level]
            if len(full) < FAN:
                break
            if level + 1 == BASE:
                full = [r for r in runs if r[0] == BASE] + full
            rows = self._rows(full)
            merged = self._run(level + 1, full[0][1], full[-1][2], rows.where(self.standing) if level + 1 == BASE else rows)
            runs = [r for r in runs if r not in full] + [merged]
        self.spark.createDataFrame(runs, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_manifests/v={batch:012d}")
        self._tidy(before)

    def _run(self, level: int, first: int, last: int, rows: DataFrame) -> tuple[int, int, int, str]:
        path = f"{self.root}/runs/{level}-{first:012d}-{last:012d}"
        rows.write.mode("overwrite").parquet(path)
        return level, first, last, path

    def _tidy(self, before: int | None) -> None:
        """Drops manifests older than the one before the newest, and runs that neither of the two names: a reader may still be at the one before."""
        named = {r[3].rsplit("/", 1)[1] for r in self.runs()}
        if before is not None:
            named |= {r.path.rsplit("/", 1)[1] for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifests/v={before:012d}").collect()}
        for name in folders.matching(self.spark, f"{self.root}/_manifests/v=*"):
            if before is not None and int(name.rsplit("=", 1)[1]) < before:
                folders.drop(self.spark, name)
        for run in folders.matching(self.spark, f"{self.root}/runs/*"):
            if run.rsplit("/", 1)[1] not in named:
                folders.drop(self.spark, run)

    def read(self) -> DataFrame:
        """Each key's row, without its batch."""
        runs = self.runs()
        if not runs:
            raise ValueError(f"nothing has been written to {self.root}")
        return self._rows(runs).where(self.standing).drop("batch")
