"""A log of records as a streaming source by offsets: where to start, how many records a batch takes at most, and what to do where the log has lost some.

The log is a folder: partition=<number>/segment=<first offset>/…parquet, records of a segment in order of their offsets. Offsets may have gaps. The driver
lists folders and reads files' footers; tasks read the segments that a batch reaches into, as Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tripledger import schemas

SEGMENT = 1_000_000
EARLIEST, LATEST = "earliest", "latest"


def write_log(log: DataFrame, root: str, segment: int = SEGMENT) -> None:
    """Adds records (key, value, partition, offset, timestamp) to the log."""
    names = [c.split()[0] for c in schemas.LOG_RECORD.split(", ")]
    rows = log.select(*names).withColumn("segment", F.floor(F.col("offset") / segment) * segment)
    rows.repartition("partition", "segment").sortWithinPartitions("partition", "segment", "offset").write.mode("append").partitionBy("partition", "segment").parquet(root)


def _file_system(root: str):
    return pa.fs.FileSystem.from_uri(root) if root.startswith("file:") or "://" in root else (pa.fs.LocalFileSystem(), root)


class Segment(InputPartition):
    """Offsets from lo up to and without hi of one file."""

    def __init__(self, file: str, partition: int, lo: int, hi: int):
        self.file, self.partition, self.lo, self.hi = file, partition, lo, hi


class LogReader(DataSourceStreamReader):
    """Offsets are {partition: the next record's offset}. A partition that appears later is read from its beginning."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.start = options.get("startingoffsets", EARLIEST)
        self.cap = int(options["maxoffsetspertrigger"]) if "maxoffsetspertrigger" in options else None
        self.checkpoint = options.get("checkpointlocation")
        if self.cap is not None and self.checkpoint is None:
            raise ValueError("maxOffsetsPerTrigger needs the query's checkpointLocation, which tells after a restart how far it has come")
        self.strict = options.get("failondataloss", "true").lower() == "true"
        self.fs, self.folder = _file_system(self.root)
        self.at: dict[str, int] | None = None

    def _segments(self) -> dict[int, list[tuple[int, int, str]]]:
        """Of each partition the first and last offset and the name of each file, in order."""
        out: dict[int, list[tuple[int, int, str]]] = {}
        for info in self.fs.get_file_info(pa.fs.FileSelector(self.folder, recursive=True, allow_not_found=True)):
            if info.type != pa.fs.FileType.File or not info.path.endswith(".parquet") or "/partition=" not in info.path:
                continue
            meta = pq.read_metadata(info.path, filesystem=self.fs)
            at = meta.schema.names.index("offset")
            stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
            if stats:
                p = int(info.path.split("/partition=")[1].split("/")[0])
                out.setdefault(p, []).append((min(s.min for s in stats), max(s.max for s in stats), info.path))
        return {p: sorted(files) for p, files in out.items()}

    def initialOffset(self) -> dict:
        found = self._segments()
        if self.start == EARLIEST:
            self.at = {str(p): files[0][0] for p, files in found.items()}
        elif self.start == LATEST:
            self.at = {str(p): files[-1][1] + 1 for p, files in found.items()}
        else:
            self.at = {str(p): int(o) for p, o in json.loads(self.start).items()}
        return self.at

    def _resumed(self) -> dict | None:
        """The end of the last batch that the query has planned, as its checkpoint tells: the last line of the newest file of offsets."""
        fs, folder = _file_system(self.checkpoint)
        names = [i.path for i in fs.get_file_info(pa.fs.FileSelector(f"{folder}/offsets", allow_not_found=True)) if i.base_name.isdigit()]
        if not names:
            return None
        with fs.open_input_stream(max(names, key=lambda n: int(n.rsplit("/", 1)[1]))) as file:
            return json.loads(file.read().decode().splitlines()[-1])

    def latestOffset(self) -> dict:
        """The end of the log, or as far as the cap allows, shared out evenly. This is asked for before anything else, also after a restart."""
        found = self._segments()
        if self.cap is not None and self.at is None:
            self.at = self._resumed() or self.initialOffset()
        ends = {str(p): max(last for _, last, _ in files) + 1 for p, files in found.items()} | {p: o for p, o in (self.at or {}).items() if int(p) not in found}
        if self.cap is not None and self.at is not None:
            starts = {p: self.at.get(p, found[int(p)][0][0] if int(p) in found else 0) for p in ends}
            each = max(1, self.cap // max(1, sum(ends[p] > starts[p] for p in ends)))
            ends = {p: max(starts[p], min(ends[p], starts[p] + each)) for p in ends}
        self.at = {p: max(o, (self.at or {}).get(p, o)) for p, o in ends.items()}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        self.at = dict(end)
        found, out = self._segments(), []
        for p, hi in end.items():
            files = found.get(int(p), [])
            lo = start.get(p, files[0][0] if files else hi)
            if self.strict and lo < hi and p in start and (not files or files[0][0] > lo):
                raise ValueError(f"partition {p}: offsets from {lo} are gone, the log begins at {files[0][0] if files else 'nothing'}")
            out += [Segment(name, int(p), lo, hi) for first, last, name in files if first < hi and last >= lo]
        return out

    def read(self, part: Segment) -> Iterator[pa.RecordBatch]:
        rows = pq.read_table(part.file, columns=["key", "value", "offset", "timestamp"], filters=[("offset", ">=", part.lo), ("offset", "<", part.hi)], filesystem=self.fs, partitioning=None)
        rows = rows.append_column("partition", pa.array([part.partition] * len(rows), pa.int32())).select(["key", "value", "partition", "offset", "timestamp"])
        yield from rows.cast(pa.schema([("key", pa.binary()), ("value", pa.binary()), ("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.timestamp("us", "UTC"))])).to_batches()


class Log(DataSource):
    """Options: path, startingOffsets (earliest, latest, or JSON of partition to offset), maxOffsetsPerTrigger with checkpointLocation, failOnDataLoss."""

    @classmethod
    def name(cls) -> str:
        return "offset_log"

    def schema(self) -> str:
        return schemas.LOG_RECORD

    def streamReader(self, schema) -> LogReader:
        return LogReader({k.lower(): v for k, v in self.options.items()})


def stream_log(spark: SparkSession, root: str, starting: str = EARLIEST, most: int | None = None, checkpoint: str | None = None, fail_on_data_loss: bool = True) -> DataFrame:
    """The log's records as a stream; most, a batch's records, needs the checkpoint folder of the query that reads them, which must be its only source. Offsets below the log's beginning, asked for or lost since, are an error, or passed over without fail_on_data_loss."""
    spark.dataSource.register(Log)
    reader = spark.readStream.format("offset_log").option("path", root).option("startingOffsets", starting).option("failOnDataLoss", str(fail_on_data_loss).lower())
    return (reader.option("maxOffsetsPerTrigger", str(most)).option("checkpointLocation", checkpoint) if most else reader).load()
