"""Folders that driver and executors share, and files that appear whole or not at all."""

from __future__ import annotations

import json
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, else in the context's checkpoint folder.

    Where neither is set, a local run gets a temporary folder, which becomes the
    context's; on a cluster that would be one machine's disk, so it is an error.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cladewise"))
        top = context.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class _Scopes(threading.local):
    def __init__(self):
        self.paths: list[list[str]] = []


_scopes = _Scopes()


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what `materialised` wrote within, in this thread; no plan may read it after."""
    _scopes.paths.append([])
    try:
        yield
    finally:
        for path in _scopes.paths.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cleaning(work):
    """work(spark, ...) that leaves no scratch table behind; what it returns must not read any."""

    @wraps(work)
    def run(spark, *args, **more):
        with cleaned(spark):
            return work(spark, *args, **more)

    return run


def materialised(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once to the shared folder and read back: what depends on it twice sees the same rows, also after a lost executor."""
    path = scratch(df.sparkSession, name)
    if _scopes.paths:
        _scopes.paths[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_text(path: str | Path, content: str) -> None:
    """A local file, first under another name."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    try:
        part.write_text(content, encoding="utf-8")
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)


def write_json(path: str | Path, value) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def replace(files, fresh, target, old) -> None:
    """Moves the path fresh to target on a file system whose rename tells by its result whether it worked; what was at target waits at old."""
    if files.exists(target):
        files.delete(old, True)
        if not files.rename(target, old):
            raise OSError(f"{target} can't be moved aside")
    if not files.rename(fresh, target):
        if files.exists(old) and not files.rename(old, target):
            raise OSError(f"{fresh} can't be moved to {target}; the earlier result is at {old}")
        raise OSError(f"{fresh} can't be moved to {target}")
    files.delete(old, True)


def write_parquet(df: DataFrame, path: str, rows_a_file: int = 0, sort: list[str] | None = None) -> int:
    """Parquet with zstd under another name first, then renamed; returns the number of rows, counted while writing.

    Nothing stays of a failed write. An earlier result is moved aside, not deleted, until
    the new one is in its place; if that move fails, the earlier one is moved back.
    """
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    spark = df.sparkSession
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    out = (df.orderBy(*sort) if sort else df).observe(seen, F.count(F.lit(1)).alias("n"))
    part, aside = f"{path}.part", f"{path}.old"
    jvm = spark._jvm
    target, half, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, part, aside))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        writer = out.write.mode("overwrite").option("compression", "zstd")
        (writer.option("maxRecordsPerFile", rows_a_file) if rows_a_file else writer).parquet(part)
        replace(files, half, target, old)
    finally:
        files.delete(half, True)
    return seen.get["n"]
