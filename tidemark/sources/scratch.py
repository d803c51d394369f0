"""Scratch folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_OWN = "spark.tidemark.scratch"
_folders: dict[str, str] = {}
_open: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only where it names none and the master is local, as in tests, a temporary folder of this machine is made,
    and goes with the process. On a cluster executors could not see such a folder, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_OWN, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set(_OWN, folder)
    return folder.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _own_folder(spark: SparkSession) -> str:
    """The application's folder in the shared one; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        path = f"{shared_folder(spark)}/tidemark-{app}-{uuid.uuid4().hex}"
        fs, at = _hadoop(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _folders[app] = path
    return _folders[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes with the scope that is open, else with the driver."""
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    held = _open.get()
    if held is not None:
        held.append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders that scratch() named."""
    for p in paths:
        if "/tidemark-" in p:
            fs, at = _hadoop(spark, p)
            fs.delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """All scratch paths that are made inside are deleted at the end: results must be written or collected before."""
    token = _open.set([])
    try:
        yield
    finally:
        held = _open.get() or []
        _open.reset(token)
        delete(spark, *held)
