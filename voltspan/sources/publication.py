"""Publication of tables in versions: a manifest names the live one and is replaced by one rename, so a reader never finds none.

With a version's rows go its statistics, gathered by the job that writes them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "live.json"


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    conf, place = spark.sparkContext._jsc.hadoopConfiguration(), hadoop.fs.Path(path)
    return hadoop, hadoop.fs.FileContext.getFileContext(place.getFileSystem(conf).makeQualified(place).toUri(), conf)


def write_counted(df: DataFrame, path: str, counts: Mapping[str, Column]) -> dict[str, int]:
    """Writes rows as Parquet; how many there are (`rows`), and for how many each of the conditions holds. One job: the counts are observed as rows pass."""
    seen = Observation()
    columns = [F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in counts.items())]
    df.observe(seen, *columns).write.parquet(path)
    return {k: int(v or 0) for k, v in seen.get.items()}


def merged(*envelopes: Mapping[str, int]) -> dict[str, int]:
    """Counters of several feeds: those of one name are added."""
    return {k: sum(e.get(k, 0) for e in envelopes) for k in dict.fromkeys(k for e in envelopes for k in e)}


def publish(df: DataFrame, path: str, counts: Mapping[str, Column] | None = None) -> dict[str, int] | None:
    """Writes the rows as a new version and makes it the live one; returns its statistics. Without rows nothing changes: None, the last good version stays.

    A job that dies before the rename leaves the old version live, and at most a version that nothing names.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    stats = write_counted(df, f"{path}/versions/{version}", counts or {})
    if not stats["rows"]:
        return None
    make_live(df.sparkSession, path, version, stats)
    return stats


def make_live(spark: SparkSession, path: str, version: str, stats: Mapping[str, int]) -> None:
    hadoop, files = _files(spark, path)
    beside, live = hadoop.fs.Path(f"{path}/{MANIFEST}-{version}"), hadoop.fs.Path(f"{path}/{MANIFEST}")
    flags = spark.sparkContext._jvm.java.util.EnumSet.of(hadoop.fs.CreateFlag.CREATE, hadoop.fs.CreateFlag.OVERWRITE)
    out = files.create(beside, flags, spark.sparkContext._gateway.new_array(hadoop.fs.Options.CreateOpts, 0))
    out.write(json.dumps({"version": version, "stats": dict(stats)}).encode())
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    overwrite[0] = hadoop.fs.Options.Rename.OVERWRITE
    files.rename(beside, live, overwrite)


def live_manifest(spark: SparkSession, path: str) -> dict | None:
    """The live version and its statistics; None before the first."""
    hadoop, files = _files(spark, path)
    if not files.util().exists(hadoop.fs.Path(f"{path}/{MANIFEST}")):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{MANIFEST}").collect()))


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the live version. A reader that has begun goes on with the version that it found."""
    manifest = live_manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    return spark.read.parquet(f"{path}/versions/{manifest['version']}")


def collect_versions(spark: SparkSession, path: str, grace_seconds: float = 3600.0) -> list[str]:
    """Deletes versions that are older than the live one and than the time that readers may need; returns their names. Newer ones may be about to become live."""
    hadoop, files = _files(spark, path)
    manifest = live_manifest(spark, path)
    if manifest is None:
        return []
    found, gone = files.util().listStatus(hadoop.fs.Path(f"{path}/versions")), []
    for status in found:
        name = status.getPath().getName()
        if name < manifest["version"] and int(name.split("-")[0]) < time.time_ns() - grace_seconds * 1e9:
            files.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
