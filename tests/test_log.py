"""The log source: every start, gaps and losses, a cap a batch, and a restart."""

import shutil
from datetime import datetime

import pytest

from tripledger.sources import log


def add(spark, root, first, last, partition=0, segment=10):
    rows = [(b"k", str(o).encode(), partition, o, datetime(2024, 1, 1)) for o in range(first, last)]
    log.write_log(spark.createDataFrame(rows, "key binary, value binary, partition int, offset long, timestamp timestamp"), root, segment)


def read(spark, root, out, **options):
    """What a run adds, batch by batch."""
    seen = []
    q = log.stream_log(spark, root, **options).writeStream.option("checkpointLocation", f"{out}/c").foreachBatch(lambda b, k: seen.append(sorted((r.partition, r.offset) for r in b.collect())))
    q = q.trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [s for s in seen if s]


def test_earliest_latest_and_offsets(spark, tmp_path):
    root = str(tmp_path / "log")
    add(spark, root, 3, 25)
    add(spark, root, 0, 7, partition=1)
    whole = [(0, o) for o in range(3, 25)] + [(1, o) for o in range(7)]
    assert sum(read(spark, root, tmp_path / "a"), []) == whole
    assert read(spark, root, tmp_path / "b", starting="latest") == []
    assert sum(read(spark, root, tmp_path / "c", starting='{"0": 20, "1": 7}'), []) == [(0, o) for o in range(20, 25)]
    add(spark, root, 30, 33)  # after a gap
    add(spark, root, 7, 9, partition=1)
    add(spark, root, 0, 2, partition=2)  # a new partition is read from its beginning
    assert sorted(sum(read(spark, root, tmp_path / "a"), [])) == [(0, 30), (0, 31), (0, 32), (1, 7), (1, 8), (2, 0), (2, 1)]
    assert sorted(sum(read(spark, root, tmp_path / "b"), [])) == [(0, 30), (0, 31), (0, 32), (1, 7), (1, 8), (2, 0), (2, 1)]
    assert read(spark, root, tmp_path / "a") == []


def test_a_batch_takes_no_more_than_its_cap(spark, tmp_path):
    root = str(tmp_path / "log")
    add(spark, root, 0, 25)
    add(spark, root, 0, 5, partition=1)
    capped = {"most": 10, "checkpoint": str(tmp_path / "a" / "c")}
    batches = read(spark, root, tmp_path / "a", **capped)
    assert sorted(sum(batches, [])) == [(0, o) for o in range(25)] + [(1, o) for o in range(5)] and max(map(len, batches)) == 10 and len(batches) >= 3
    add(spark, root, 25, 60)
    again = read(spark, root, tmp_path / "a", **capped)  # a restart goes on where the last batch ended
    assert sum(again, []) == [(0, o) for o in range(25, 60)] and max(map(len, again)) == 10
    with pytest.raises(Exception, match="checkpointLocation"):
        log.LogReader({"path": root, "maxoffsetspertrigger": "10"})


def test_lost_offsets(spark, tmp_path):
    root = str(tmp_path / "log")
    add(spark, root, 0, 25)
    assert len(sum(read(spark, root, tmp_path / "a", starting='{"0": 15}'), [])) == 10
    for segment in (0, 10):
        shutil.rmtree(f"{root}/partition=0/segment={segment}")
    with pytest.raises(Exception, match="are gone"):
        read(spark, root, tmp_path / "b", starting='{"0": 5}')
    assert sum(read(spark, root, tmp_path / "c", starting='{"0": 5}', fail_on_data_loss=False), []) == [(0, o) for o in range(20, 25)]
