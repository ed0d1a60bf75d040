"""Tables that are changed by key: rows in buckets of files, a manifest for every version.

A change reads and writes the buckets it touches only; the others stay as the files they are. The new files lie in a folder of
their own, and the version counts once its manifest is written, so readers see one version whole and a writer that dies
before that leaves the table as it was. One writer at a time: a second one finds its version taken and fails.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.operators.upserts import last_by_arrival, upsert_partial, upsert_replace
from fleetloom.session import drop_folder, pin

BUCKET = "_bucket"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that count, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(at) if fs.exists(at) else []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(s.getPath().getName()) for s in found if done(s.getPath()))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version is made of: keys, buckets, schema, and ``held``, the version whose files each bucket that has rows is in."""
    if version is None:
        found = versions(spark, path)
        if not found:
            raise LookupError(f"no table at {path}")
        version = found[-1]
    return json.loads(spark.read.text(f"{path}/versions/{version}").first()[0]) | {"version": version}


def _read(spark: SparkSession, path: str, m: dict, buckets: Sequence[int] | None = None) -> DataFrame:
    held = {int(b): v for b, v in m["held"].items() if buckets is None or int(b) in buckets}
    schema = T.StructType.fromJson(m["schema"])
    if not held:
        return spark.createDataFrame([], schema)
    # One path per bucket, so that nothing else is listed.
    return spark.read.schema(schema).parquet(*[f"{path}/data/{v}/{BUCKET}={b}" for b, v in sorted(held.items())])


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest one unless named."""
    return _read(spark, path, manifest(spark, path, version))


def _commit(rows: DataFrame, path: str, m: dict, touched: Sequence[int]) -> int:
    """Write ``rows``, all there are now in the ``touched`` buckets, as the next version."""
    spark, version = rows.sparkSession, m["version"] + 1
    folder = f"{path}/data/{version}"
    writer = rows.withColumn(BUCKET, _bucket(m["keys"], m["buckets"])).hint("rebalance", F.col(BUCKET)).write.mode("overwrite")
    # Static: what a dead writer of this version has left goes away.
    writer.option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(folder)
    filled = [r[0] for r in spark.read.schema(f"{BUCKET} int").parquet(folder).select(BUCKET).distinct().collect()]
    held = {b: v for b, v in m["held"].items() if int(b) not in set(touched)} | {str(b): version for b in filled}
    _write_manifest(spark, f"{path}/versions/{version}", {k: m[k] for k in ("keys", "buckets", "schema")} | {"held": held})
    return version


def _write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def create_versioned(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> int:
    """Lay ``df`` down as version 0; ``keys`` are unique. Choose ``buckets`` so that one is some hundred MB."""
    m = {"keys": list(keys), "buckets": buckets, "schema": df.schema.jsonValue(), "held": {}, "version": -1}
    if versions(df.sparkSession, path):
        raise FileExistsError(f"there is a table at {path}")
    return _commit(df, path, m, [])


def merge_batch(
    spark: SparkSession, path: str, batch: DataFrame, arrival: Sequence[str], update: Sequence[str] | None = None, defaults: Mapping[str, object] | None = None
) -> int:
    """Upsert ``batch`` by key and return the version; with ``update`` known rows take over those columns only.

    Rules as in ``upsert_replace`` and ``upsert_partial``. Of rows with one key the last by ``arrival`` counts. An empty batch
    makes no version.
    """
    m = manifest(spark, path)
    keys = m["keys"]
    new = pin(last_by_arrival(batch, keys, arrival))
    touched = [r[0] for r in new.select(_bucket(keys, m["buckets"])).distinct().collect()]  # as many as there are buckets, at most
    if not touched:
        return m["version"]
    target = _read(spark, path, m, touched)
    merged = upsert_replace(target, new, keys, arrival, defaults) if update is None else upsert_partial(target, new, keys, update, arrival)
    return _commit(merged.select(*target.columns), path, m, touched)


def bounded_delete(spark: SparkSession, path: str, where: Column, step_rows: int) -> list[tuple[int, int]]:
    """Delete the rows that fit ``where``, at most ``step_rows`` for each version; returns (version, rows) of the steps.

    Every step is committed by itself, so a run that stops has deleted whole steps and the next one goes on. Steps go
    through the buckets in order, so each reads and rewrites only the few that hold its rows: they are counted once.
    """
    steps, m = [], manifest(spark, path)
    keys, bucket = m["keys"], _bucket(m["keys"], m["buckets"])
    ahead = dict(sorted((r[0], r[1]) for r in _read(spark, path, m).filter(where).groupBy(bucket).count().collect()))  # one row per bucket
    while ahead:
        some, n = [], 0
        for b, count in ahead.items():
            some, n = [*some, b], n + count
            if n >= step_rows:
                break
        doomed = pin(_read(spark, path, m, some).filter(where).select(*keys, bucket).orderBy(BUCKET, *keys).limit(step_rows))
        counts = {r[0]: r[1] for r in doomed.groupBy(BUCKET).count().collect()}
        gone = doomed.select(*[F.col(k).alias(f"_d_{k}") for k in keys])
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys])
        touched = sorted(counts)
        steps.append((_commit(_read(spark, path, m, touched).join(gone, same, "left_anti"), path, m, touched), sum(counts.values())))
        ahead = {b: left for b, c in ahead.items() if (left := c - counts.get(b, 0))}
        m = manifest(spark, path, steps[-1][0])
    return steps


def forget_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove all but the newest ``keep`` versions, and files that none of those uses; returns the versions removed."""
    found = versions(spark, path)
    old, used = found[:-keep], {v for x in found[-keep:] for v in manifest(spark, path, x)["held"].values()}
    for v in old:
        drop_folder(spark, f"{path}/versions/{v}")
        if v not in used:
            drop_folder(spark, f"{path}/data/{v}")
    return old
