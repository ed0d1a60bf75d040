"""Bucketed tables: what a change writes, what readers see, deleting in steps."""

import pytest
from pyspark.sql import functions as F

from fleetloom.sources import versioned


@pytest.fixture
def path(spark, tmp_path):
    df = spark.range(400).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), F.lit(1).alias("n"))
    versioned.create_versioned(df, str(tmp_path / "t"), ["id"], 16)
    return str(tmp_path / "t")


def state(spark, path, version=None):
    return {r["id"]: (r["v"], r["n"]) for r in versioned.read_version(spark, path, version).collect()}


def batch(spark, rows):
    return spark.createDataFrame(rows, "id long, v string, at long")


def test_a_batch_writes_the_buckets_it_touches(spark, path, tmp_path):
    before = state(spark, path)
    assert len(before) == 400
    assert versioned.merge_batch(spark, path, batch(spark, [(7, "old", 1), (7, "new", 2)]), ["at"], update=["v"]) == 1
    assert len(list((tmp_path / "t" / "data" / "1").glob("_bucket=*"))) == 1
    assert state(spark, path) == {**before, 7: ("new", 1)} and state(spark, path, 0) == before
    # Replacing takes defaults for what the batch lacks; a new key is a new row.
    assert versioned.merge_batch(spark, path, batch(spark, [(8, "x", 1), (1000, "y", 1)]), ["at"], defaults={"n": 5}) == 2
    assert state(spark, path) == {**before, 7: ("new", 1), 8: ("x", 5), 1000: ("y", 5)}
    assert versioned.merge_batch(spark, path, batch(spark, []), ["at"]) == 2


def test_a_writer_that_dies_leaves_the_old_version(spark, path, monkeypatch):
    before = state(spark, path)
    with monkeypatch.context() as m:
        m.setattr(versioned, "_write_manifest", lambda *_: 1 / 0)  # after the data, before the manifest
        with pytest.raises(ZeroDivisionError):
            versioned.merge_batch(spark, path, batch(spark, [(i, "lost", 1) for i in range(50)]), ["at"])
    assert versioned.versions(spark, path) == [0] and state(spark, path) == before
    assert versioned.merge_batch(spark, path, batch(spark, [(3, "kept", 1)]), ["at"], update=["v"]) == 1
    assert state(spark, path) == {**before, 3: ("kept", 1)}


def test_a_second_writer_fails(spark, path):
    m = versioned.manifest(spark, path)
    versioned.merge_batch(spark, path, batch(spark, [(3, "first", 1)]), ["at"], update=["v"])
    with pytest.raises(Exception, match="(?i)exist"):
        versioned._commit(versioned.read_version(spark, path, 0), path, m, list(range(16)))
    with pytest.raises(FileExistsError):
        versioned.create_versioned(spark.range(1), path, ["id"])


def test_delete_in_steps(spark, path):
    before = state(spark, path)
    steps = versioned.bounded_delete(spark, path, F.col("id") < 100, 30)
    assert [n for _, n in steps] == [30, 30, 30, 10] and [v for v, _ in steps] == [1, 2, 3, 4]
    sizes = [len(state(spark, path, v)) for v in range(5)]
    assert sizes == [400, 370, 340, 310, 300]
    assert state(spark, path) == {k: v for k, v in before.items() if k >= 100}
    assert versioned.bounded_delete(spark, path, F.col("id") < 100, 30) == []
    assert versioned.forget_versions(spark, path, 2) == [0, 1, 2]
    assert len(state(spark, path)) == 300 and len(state(spark, path, 3)) == 310
    # All rows may go; the table stays and takes new ones.
    versioned.bounded_delete(spark, path, F.lit(True), 10_000)
    assert state(spark, path) == {}
    versioned.merge_batch(spark, path, batch(spark, [(1, "again", 1)]), ["at"])
    assert state(spark, path) == {1: ("again", None)}


def test_a_delete_step_reads_only_the_buckets_of_its_rows(spark, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "t"), []
    versioned.create_versioned(spark.range(2000).withColumnRenamed("id", "k"), path, ["k"], 20)
    read = versioned._read
    monkeypatch.setattr(versioned, "_read", lambda s, p, m, buckets=None: asked.append(buckets) or read(s, p, m, buckets))
    steps = versioned.bounded_delete(spark, path, F.col("k") % 2 == 0, 150)
    assert [n for _, n in steps] == [150] * 6 + [100]
    assert asked[0] is None and all(len(b) <= 6 for b in asked[1:])
    assert versioned.read_version(spark, path).filter("k % 2 = 0").isEmpty() and versioned.read_version(spark, path).count() == 1000
