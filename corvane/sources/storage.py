"""Small driver-side reads and writes in whatever store the path belongs to."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder and all in it; one that is not there is fine."""
    fs, at = _at(spark, path)
    fs.delete(at, True)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object in a small file; None if there is no such file."""
    if not exists(spark, path):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, in order of names; nothing if it is not there."""
    fs, at = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def work_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, or the warehouse where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/corvane-{what}-{uuid.uuid4().hex}"


def _draft(spark: SparkSession, path: str, value: dict):
    """(file system, finished draft, target) of a small file."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    draft = fs.makeQualified(_at(spark, f"{at.getParent()}/.{at.getName()}.{uuid.uuid4().hex}")[1])
    out = fs.create(draft, True)
    out.write(json.dumps(value, indent=2).encode())
    out.close()
    return fs, draft, fs.makeQualified(at)


def create_json(spark: SparkSession, path: str, value: dict) -> bool:
    """Write a small file unless there is one of its name, in one step; of several writers one is told True. The others' drafts are removed."""
    fs, draft, at = _draft(spark, path, value)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        if fs.getUri().getScheme() == "file":  # a rename would take the place of a file that another writer has just made
            file = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(file(at), file(draft))
        else:
            never = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, at, never)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)
    return True


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Replace a small file in one step, by renaming a finished one over it."""
    fs, draft, at = _draft(spark, path, value)
    hadoop, gateway = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    over = gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, at, over)
