"""Runs over an inbox: one at a time, their state in a file of the shared folder, and the moves of the files they have settled."""

from __future__ import annotations

import contextlib
import json
import time
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

LOCK, STATE = "running", "state.json"


class Busy(Exception):
    """Another run has the folder."""


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _write(spark: SparkSession, path: str, content: dict) -> None:
    fs, target = _at(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(json.dumps(content, default=str).encode()))
    out.close()


def state(spark: SparkSession, folder: str) -> dict:
    """running, and began, ended and result of the last run that wrote them."""
    fs, target = _at(spark, f"{folder}/{STATE}")
    said = json.loads(spark.read.text(f"{folder}/{STATE}", wholetext=True).first()[0]) if fs.exists(target) else {}
    lock_fs, lock = _at(spark, f"{folder}/{LOCK}")
    return said | {"running": bool(lock_fs.exists(lock))}


@contextlib.contextmanager
def one_at_a_time(spark: SparkSession, folder: str) -> Iterator[dict]:
    """Holds the folder for one run, or raises Busy. What the block puts into the dictionary becomes the run's result. A run that
    was killed leaves its lock; clear() takes it away."""
    fs, lock = _at(spark, f"{folder}/{LOCK}")
    fs.mkdirs(lock.getParent())
    if not _taken(fs, lock):
        raise Busy(f"a run is going on in {folder}")
    began, result = time.time(), {}
    try:
        yield result
        _write(spark, f"{folder}/{STATE}", {"began": began, "ended": time.time(), "result": result})
    finally:
        fs.delete(lock, False)


def _taken(fs: JavaObject, lock: JavaObject) -> bool:
    """Whether the lock's file was made just now; file systems make a file at most once without overwriting."""
    from py4j.protocol import Py4JJavaError

    try:
        fs.create(lock, False).close()
        return True
    except Py4JJavaError as problem:
        if "exist" not in str(problem.java_exception).lower():
            raise
        return False


def clear(spark: SparkSession, folder: str) -> None:
    fs, lock = _at(spark, f"{folder}/{LOCK}")
    fs.delete(lock, False)


def move_files(moves: DataFrame, root: str) -> dict[str, int]:
    """Moves files under root as a manifest (path, dest) says, one batch's worth: names only pass through the driver, a few at a
    time. A file that is gone or whose place is taken stays, and is counted as such."""
    spark = moves.sparkSession
    count = {"moved": 0, "gone": 0, "taken": 0}
    for r in moves.select("path", "dest").where("path <> dest").toLocalIterator():
        fs, source = _at(spark, f"{root}/{r['path']}")
        _, target = _at(spark, f"{root}/{r['dest']}")
        if not fs.exists(source):
            count["gone"] += 1
        elif fs.exists(target):
            count["taken"] += 1
        else:
            fs.mkdirs(target.getParent())
            count["moved" if fs.rename(source, target) else "taken"] += 1
    return count
