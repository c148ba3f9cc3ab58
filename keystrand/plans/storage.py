"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where it is unset."""
    for conf in (spark.conf, spark.sparkContext.getConf()):
        if found := conf.get("spark.checkpoint.dir", None):
            return found.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keystrand-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(drop)
    return path


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's API."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    store, where = hadoop(spark, path)
    store.delete(where, True)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file under another name, then rename it over the old one."""
    store, draft = hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(draft, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = files.FileContext.getFileContext(draft.toUri(), conf) if draft.toUri().getScheme() else files.FileContext.getFileContext(conf)
    overwrite = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
    overwrite[0] = files.Options.Rename.OVERWRITE
    context.rename(draft, files.Path(path), overwrite)


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file's bytes; None if there is no file."""
    store, where = hadoop(spark, path)
    if not store.exists(where):
        return None
    stream = store.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
