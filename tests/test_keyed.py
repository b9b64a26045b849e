"""Tables merged by file: what is rewritten, what stays, and what readers of each version see."""

import random

import pytest
from pyspark.sql import functions as F

from tripledger.operators import mart
from tripledger.sources.keyed import KeyedTable

SCHEMA = "vehicle_id string, sim_date string, profit double, job_run_id string"
KEY = ["vehicle_id", "sim_date"]


def rows_of(df):
    return {(r.vehicle_id, str(r.sim_date)): (r.profit, r.job_run_id) for r in df.collect()}


def fleet(days, vehicles, run="run-1"):
    return [(f"V{v:03d}", f"2024-01-{d:02d}", float(v * d), run) for d in days for v in vehicles]


def files(table, version=None):
    return {r.file for r in table.manifest(version).collect()}


def test_a_day_leaves_the_files_of_other_days_in_place(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), KEY, "sim_date", file_rows=40)
    t.write(spark.createDataFrame(fleet(range(1, 11), range(100)), SCHEMA))
    before, first = files(t), rows_of(t.read())
    done = t.merge(spark.createDataFrame(fleet([5], range(100), "run-2"), SCHEMA), mart.upsert)
    of_day = {f for f in before if "sim_date=2024-01-05" in f}
    assert 1 < len(of_day) < len(before) and done.rewritten == len(of_day) and done.kept == len(before) - len(of_day)
    assert files(t) & before == before - of_day
    want = first | {k: (p, "run-2") for k, (p, _) in first.items() if k[1] == "2024-01-05"}
    assert rows_of(t.read()) == want and rows_of(t.read(version=0)) == first
    assert rows_of(t.read(["2024-01-05"])) == {k: v for k, v in want.items() if k[1] == "2024-01-05"}


def test_one_key_rewrites_one_file_and_a_new_key_none(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), KEY, "sim_date", file_rows=50)
    t.write(spark.createDataFrame(fleet([1, 2], range(0, 400, 2)), SCHEMA))
    n = len(files(t))
    done = t.merge(spark.createDataFrame(fleet([2], [100], "run-2"), SCHEMA), mart.upsert)
    assert (done.rewritten, done.rows_in) == (1, 1) and n > 4
    before = rows_of(t.read())
    done = t.merge(spark.createDataFrame(fleet([1, 3], [101], "run-3"), SCHEMA), mart.upsert)  # between two keys of a file, and a day of its own
    assert done.rewritten == 0 and rows_of(t.read()) == before | {(v, d): (p, r) for v, d, p, r in fleet([1, 3], [101], "run-3")}
    done = t.merge(spark.createDataFrame([], SCHEMA), mart.upsert)
    assert done.rewritten == 0 and done.version == t.version()


@pytest.mark.parametrize("seed", range(2))
def test_merges_equal_a_dictionary(spark, tmp_path, seed):
    rng = random.Random(seed)
    t = KeyedTable(spark, str(tmp_path), KEY, "sim_date", file_rows=rng.choice([7, 1000]))
    state = {(v, d): (p, r) for v, d, p, r in fleet([1, 2], range(20))}
    t.write(spark.createDataFrame([(*k, *v) for k, v in state.items()], SCHEMA))
    for run in range(3):
        new = {(f"V{rng.randrange(40):03d}", f"2024-01-{rng.randint(1, 4):02d}"): (rng.random(), f"m{run}") for _ in range(rng.randint(1, 25))}
        t.merge(spark.createDataFrame([(*k, *v) for k, v in new.items()], SCHEMA), mart.upsert)
        state |= new
        assert rows_of(t.read()) == state
    assert t.vacuum() > 0 and rows_of(t.read()) == state and {str(p).rsplit("/", 1)[1] for p in tmp_path.glob("data/*/*/*.parquet")} == {f.rsplit("/", 1)[1] for f in files(t)}


def test_restatements_through_a_merge(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), KEY, "sim_date")
    t.write(spark.createDataFrame(fleet([1, 2], range(3)), SCHEMA).withColumns({"restated_at": F.lit(None).cast("timestamp"), "restatement_count": F.lit(0)}))
    resolve = lambda old, new, key: mart.upsert_restated(old, new, key, F.current_timestamp())
    for _ in range(2):
        t.merge(spark.createDataFrame(fleet([2], range(3), "run-2"), SCHEMA), resolve)
    assert {(r.sim_date.isoformat() if hasattr(r.sim_date, "isoformat") else r.sim_date, r.restatement_count) for r in t.read().collect()} == {("2024-01-01", 0), ("2024-01-02", 1)}


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = (KeyedTable(spark, str(tmp_path), KEY, "sim_date") for _ in range(2))
    a.write(spark.createDataFrame(fleet([1], range(3)), SCHEMA))
    entries = b.manifest()
    a.merge(spark.createDataFrame(fleet([1], [1], "run-2"), SCHEMA), mart.upsert)
    with pytest.raises(Exception, match="already exists"):
        b._commit(entries, 0)  # as if it had read version 0 before a's merge
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "none"), KEY, "sim_date").read()
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path), ["vehicle_id"], "sim_date")
