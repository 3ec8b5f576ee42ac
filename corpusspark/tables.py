"""Reading the input tables and cutting lineage with written tables."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\s\p{Z}\x1c-\x1f\x85]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name; timestamps without zone are read as they are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(c: Column) -> Column:
    """Without white space (Unicode, control separators included) at both ends; null stays null."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder serves a local master only; on a cluster that is an error,
    as executors cannot read each other's local disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (at := spark.sparkContext.getCheckpointDir()):
        found = at
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusspark-")
        spark.sparkContext.setCheckpointDir(found)
        _remove_at_exit(spark, found)
    return found


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on the shared file system; a missing one is no error."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def run() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session has ended before
            pass

    atexit.register(run)


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end: for services and streams, whose driver does not end.

    What is read from them must have been read, or written elsewhere, by then.
    """
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            remove(spark, path)


def new_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A fresh folder name under the shared folder; it is removed at the end of the scratch() it is made in, else, or with keep, when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _scopes.get() and not keep:
        _scopes.get()[-1].append(path)
    else:
        _remove_at_exit(spark, path)
    return path


def written(df: DataFrame, tag: str, by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """df as a table written to the shared folder: later reads survive the loss of any executor. keep: see new_path()."""
    spark = df.sparkSession
    path = new_path(spark, tag, keep)
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Lets the shuffle files of ended queries go now: Spark deletes them when the driver collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def put_file(spark: SparkSession, path: str, body: str) -> bool:
    """Writes a small file whole, if there is none of that name; False if there is. Of several writers one succeeds.

    The file is written under another name first, so that readers see all of it or nothing. It gets its
    name by a link on a local file system, and by a rename elsewhere; both fail if the name is taken
    (HDFS checks that in the same step; a store that does not must be told to, by its own settings).
    """
    fs, p = _fs(spark, path)
    tmp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(p.getParent())
    if fs.exists(p):
        return False
    out = fs.create(tmp, True)
    out.write(bytearray(body.encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return bool(fs.rename(tmp, p))
        try:
            os.link(tmp.toUri().getPath(), p.toUri().getPath())
        except FileExistsError:
            raise
        except OSError:  # a mount without links
            with open(p.toUri().getPath(), "x", encoding="utf-8") as f:
                f.write(body)
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(tmp, False)


def get_file(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    n = fs.getFileStatus(p).getLen()
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; an absent folder is empty."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def file_states(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(name, bytes, time of the last change) of files."""
    found = []
    for path in sorted(paths):
        fs, p = _fs(spark, path)
        at = fs.getFileStatus(p)
        found.append((path, at.getLen(), at.getModificationTime()))
    return found
