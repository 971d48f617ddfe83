"""Lineage cuts and commits in the folder that the session shares with its executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed when the driver ends; without that setting a temporary one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tracelake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
    _made.append((weakref.ref(spark), path))
    return path


@atexit.register
def _remove_all() -> None:
    for held, path in _made:
        spark = held()
        if spark is not None and spark.sparkContext._jsc is not None:
            try:
                at, fs = filesystem(spark, path)
                fs.delete(at(path), True)
            except Exception:  # noqa: BLE001  the session may have ended before
                return


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's path class, and the file system of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with its whole content, unless it's there: of several writers one gets True, and no reader sees a part of it.

    The content is written under a name of its own first. Local and mounted folders link it
    to its place, which fails if the place is taken; other stores rename it, which must not
    replace a file there, as HDFS sees to. A store without such a rename needs a lock of its own.
    """
    at, fs = filesystem(spark, path)
    spare = f"{path}.{uuid.uuid4().hex}.part"
    fs.mkdirs(at(path).getParent())
    out = fs.create(at(spare), False)
    out.write(bytearray(text.encode()))
    out.close()
    url = urlparse(fs.makeQualified(at(path)).toUri().toString())
    if url.scheme == "file":
        local = unquote(url.path)
        try:
            os.link(f"{local}.{spare.rsplit('.', 2)[1]}.part", local)
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(at(spare), False)
    if not fs.exists(at(path)) and fs.rename(at(spare), at(path)):
        return True
    fs.delete(at(spare), False)
    return False


def names_in(spark: SparkSession, folder: str) -> list[str]:
    at, fs = filesystem(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(at(folder))] if fs.exists(at(folder)) else []
    return sorted(n for n in found if not n.endswith((".part", ".crc")))


def text_at(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    at, fs = filesystem(spark, path)
    stream = fs.open(at(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
