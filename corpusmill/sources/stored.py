"""Tables that are derived once from given ones and kept in the shared folder: written whole, then put in place."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans.frames import shared_root


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return files.exists(where)


def put_in_place(spark: SparkSession, fresh: str, path: str) -> bool:
    """Gives a folder that was written beside it the name path. A folder that has that name steps aside first and goes
    when the new one is in its place; if that fails, it comes back. False: another writer has put one there meanwhile."""
    files, new = file_system(spark, fresh)
    _, final = file_system(spark, path)
    _, aside = file_system(spark, f"{path}-old-{uuid.uuid4().hex}")
    had = files.exists(final) and files.rename(final, aside)
    if files.rename(new, final):
        if had:
            files.delete(aside, True)
        return True
    if had:
        files.rename(aside, final)
    return False


def replace_table(df: DataFrame, path: str) -> None:
    """Writes df as Parquet where readers see the table of before until the new one is whole."""
    fresh = f"{path}-new-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    if not put_in_place(df.sparkSession, fresh, path):
        raise OSError(f"{path} could not be replaced")


def print_of(spark: SparkSession, source: str) -> str:
    """A digest of names, sizes and times of a table's files: another one, and what was derived from it is stale."""
    files, where = file_system(spark, source)
    found = files.listStatus(where) if files.getFileStatus(where).isDirectory() else [files.getFileStatus(where)]
    state = sorted(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in found)
    return hashlib.sha256("\n".join(state).encode()).hexdigest()[:16]


def derived(spark: SparkSession, name: str, source: str, build: Callable[[str], None], root: str | None = None) -> str:
    """The folder that build(folder) has written from the table at source, if need be now. It is named after the source's
    files, so that a changed source is derived anew, and is only seen when whole; a build that dies leaves none."""
    if root is None:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared_root(spark))
        root = context.getCheckpointDir()
    path = f"{root.rstrip('/')}/{name}-{print_of(spark, source)}"
    if not exists(spark, path):
        fresh = f"{path}-new-{uuid.uuid4().hex}"
        build(fresh)
        files, new = file_system(spark, fresh)
        _, final = file_system(spark, path)
        if files.exists(final) or not files.rename(new, final):  # another builder was first
            files.delete(new, True)
    return path
