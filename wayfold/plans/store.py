"""Tables that several queries share, written once in the folder that all executors see."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a session that runs on this machine alone gets one here where it is unset."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        path = tempfile.mkdtemp(prefix="wayfold-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(target))


def key(spark: SparkSession, text: str, tables: list[str]) -> str:
    """A digest of a definition and of the names, sizes and times of the files it reads."""
    return hashlib.sha256(repr((text, [_files(spark, t) for t in tables])).encode()).hexdigest()[:32]


def scratch(spark: SparkSession, name: str) -> str:
    """A folder's path that all executors see, new at each call. It goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/wayfold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def kept(spark: SparkSession, name: str, digest: str, make) -> DataFrame:
    """``make()``, written at its first use in an application and read from then on. The files go when the driver's JVM ends."""
    own = (spark.sparkContext.applicationId, name, digest)
    if own not in _KEPT:
        path = f"{shared_dir(spark)}/wayfold/{spark.sparkContext.applicationId}/{name}-{digest}"
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
        _KEPT[own] = path
    return spark.read.parquet(_KEPT[own])
