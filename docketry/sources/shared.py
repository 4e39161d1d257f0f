"""What tasks on other machines need: the folder that all of them share, tables in it, and this package itself."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: dict[str, str] = {}
_shipped: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a session on one machine gets a folder of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_root[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/docketry-{name}-{uuid.uuid4().hex}"


def spill(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_table = path
    return out


def spread(df: DataFrame, rows: int, size: Column | None = None, bytes_: int = 0) -> DataFrame:
    """df over all cores and in tasks of about so many rows, and of so many bytes by `size`, however few files, splits or row groups it lies in."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0)).alias("bytes")).first()
    return df.repartition(max(cores, -(-found["n"] // rows), -(-found["bytes"] // bytes_) if bytes_ else 1))


def let_go(df: DataFrame) -> None:
    """Delete the table that spill() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_table)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks import it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="docketry-ship-"), "docketry_pkg.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("docketry", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def filesystem(uri: str):
    """(file system, path in it) of a folder that the cluster shares. Hadoop's names for a store that Arrow knows by another one are mapped."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    if not sep and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}.get(scheme, scheme) + sep + rest)
