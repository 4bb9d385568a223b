"""Paths in whatever store Spark reads and writes: whether they exist, removing them, scratch folders."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

_scratch: list[tuple[SparkSession, str]] = []


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names something."""
    fs, where = _file_system(spark, path)
    found = fs.globStatus(where)
    return found is not None and len(found) > 0


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder if it is there."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def write_text(spark: SparkSession, path: str, value: str) -> None:
    """A small file of its own, such as an index or a note."""
    fs, where = _file_system(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(value.encode()))
    finally:
        out.close()


def move_all(spark: SparkSession, moves: list[tuple[str, str]]) -> None:
    """Move the one file that each pattern names to a path, within a store; what is at the path goes. Many at a time, since each waits for the store."""
    if not moves:
        return
    fs, _ = _file_system(spark, moves[0][1])
    at = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {path.rsplit("/", 1)[0] for _, path in moves}:
        fs.mkdirs(at(folder))

    def one(each: tuple[str, str]) -> None:
        target = at(each[1])
        fs.delete(target, True)
        if not fs.rename(fs.globStatus(at(each[0]))[0].getPath(), target):
            raise OSError(f"{each[0]} can't be moved to {each[1]}")

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(one, moves))


def set_order(spark: SparkSession, paths: list[str], start: int = 1_700_000_000_000) -> None:
    """Give files the modification times of an order, a second apart, so that a stream takes them in it."""
    for k, path in enumerate(paths):
        fs, where = _file_system(spark, path)
        fs.setTimes(where, start + 1000 * k, -1)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, removed when the driver ends.

    The folder is ``spark.checkpoint.dir``; where it isn't set only a local
    master is accepted, and the path is in a new temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(root or 'file://' + tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{uuid.uuid4().hex}-{name}"
    _scratch.append((spark, path))
    return path


def _remove_all() -> None:
    while _scratch:
        spark, path = _scratch.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended: then the folder is the cluster's to clean
            continue


atexit.register(_remove_all)
