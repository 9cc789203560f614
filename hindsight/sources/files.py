"""Single small files on any file system that Spark reaches, read and written by the driver.

A file appears whole or not at all: its content is written beside it first.  Replacing is one
rename.  Creating fails if the file is there, also if two try at the same moment: on a local
disk by a hard link, elsewhere by the rename of Hadoop's FileContext, which HDFS carries out as
one step.  An object store must offer the same; Hadoop's connectors say which do.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from pathlib import Path
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class _Place:
    """A path: a local one, or one with its Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.name, self.local = path, None
        scheme = urlsplit(path).scheme or urlsplit(_default(spark)).scheme
        if scheme == "file":
            self.local = Path(urlsplit(path).path if path.startswith("file:") else path)
        else:
            self._open(spark)

    def _open(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(self.name)
        self.fs = self.path.getFileSystem(self.conf)

    def beside(self, spark: SparkSession) -> _Place:
        return _Place(spark, f"{self.name.rpartition('/')[0]}/.{uuid.uuid4().hex}")

    def write(self, data: bytes) -> None:
        if self.local:
            self.local.parent.mkdir(parents=True, exist_ok=True)
            self.local.write_bytes(data)
            return
        out = self.fs.create(self.path, True)
        out.write(bytearray(data))
        out.close()

    def rename(self, to: _Place, how: str) -> None:
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(kinds.NONE.getClass(), 1)
        options[0] = getattr(kinds, how)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.conf).rename(self.path, to.path, options)


_DEFAULTS: dict[str, str] = {}


def _default(spark: SparkSession) -> str:
    """The file system of paths that name none."""
    app = spark.sparkContext.applicationId
    if app not in _DEFAULTS:
        _DEFAULTS[app] = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return _DEFAULTS[app]


def read_file(spark: SparkSession, path: str) -> str:
    place = _Place(spark, path)
    if place.local:
        return place.local.read_text()
    stream = place.fs.open(place.path)
    try:
        return bytes(place.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a file; readers see the old one or the new one."""
    place = _Place(spark, path)
    fresh = place.beside(spark)
    fresh.write(text.encode())
    if place.local:
        os.replace(fresh.local, place.local)
    else:
        fresh.rename(place, "OVERWRITE")


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that is not there; False if it is."""
    place = _Place(spark, path)
    fresh = place.beside(spark)
    fresh.write(text.encode())
    try:
        if place.local:
            os.link(fresh.local, place.local)
        else:
            fresh.rename(place, "NONE")
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        if place.local:
            fresh.local.unlink()
        else:
            fresh.fs.delete(fresh.path, False)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder, hidden ones left out; none if there is no such folder."""
    place = _Place(spark, folder)
    if place.local:
        names = os.listdir(place.local) if place.local.is_dir() else []
    elif place.fs.exists(place.path):
        names = [entry.getPath().getName() for entry in place.fs.listStatus(place.path)]
    else:
        names = []
    return sorted(n for n in names if n and not n.startswith((".", "_")))


def matching(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """Paths that match a glob pattern, with the milliseconds of their last change."""
    place = _Place(spark, pattern)
    if place.local:
        return [(p, os.stat(p).st_mtime_ns // 1_000_000) for p in glob.glob(str(place.local))]
    return [(s.getPath().toString(), s.getModificationTime()) for s in place.fs.globStatus(place.path) or []]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all that is in it."""
    place = _Place(spark, path)
    if not place.local:
        place.fs.delete(place.path, True)
    elif place.local.is_dir():
        shutil.rmtree(place.local)
    else:
        place.local.unlink(missing_ok=True)
