"""Small files that one writer only can create, and lists of them numbered without gaps."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def target_of(spark: SparkSession, path: str):
    """The file system of a path and the path as it knows it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = target_of(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """A file or a whole folder; nothing happens if it is not there."""
    system, target = target_of(spark, path)
    system.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    system, target = target_of(spark, path)
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this writer made the file. It appears whole or not at all: written under a name
    of its own first, then given its name by a step that fails if the name is taken (a link
    on a local disk, a rename without overwriting elsewhere)."""
    jvm = spark.sparkContext._jvm
    system, target = target_of(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getUri().getScheme() == "file":
            jvm.java.nio.file.Files.createLink(*[jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)])
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri()).rename(draft, target, options)
        return True
    except Py4JJavaError as failure:
        if "AlreadyExists" in failure.java_exception.getClass().getName():
            return False
        raise
    finally:
        system.delete(draft, False)


def numbered(folder: str, number: int) -> str:
    return f"{folder}/{number:012d}"


def last_number(spark: SparkSession, folder: str) -> int:
    """Zero for none. As there are no gaps, the end is found by doubling and halving."""
    high = 1
    while exists(spark, numbered(folder, high)):
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if exists(spark, numbered(folder, middle)) else (low, middle)
    return low
