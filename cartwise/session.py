"""Session helpers: a local session for tests, and staging of shared results."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_folder: ContextVar[str] = ContextVar("folder", default="")
_own_folders: dict[str, str] = {}  # per application, where none is named


def local_session(app: str = "cartwise", cpus: int | str = 8, memory: str = "16g") -> SparkSession:
    """Session for tests and the bench. Jobs on a cluster bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "2m")  # small test files over all cores
        .config("spark.sql.files.openCostInBytes", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: ``spark.checkpoint.dir``.

    Where a session on one machine names none, as in a trial, a folder in the warehouse is used, and removed
    when the driver ends. On a cluster that is an error.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"{_CHECKPOINT_KEY} has to name a folder that all executors of {master} reach")
        app = spark.sparkContext.applicationId
        root = _own_folders.get(app)
        if root is None:
            root = _own_folders[app] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged-{app}"
            atexit.register(shutil.rmtree, urlparse(root).path, ignore_errors=True)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/cartwise/{app}/{_folder.get()}{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """Tables staged within this block lie in one folder, whose path is given, so that ``remove`` can drop them together."""
    name = f"{label}-{uuid.uuid4().hex[:12]}/"
    path = shared_path(spark, "x").rsplit("/", 1)[0] + "/" + name
    token = _folder.set(_folder.get() + name)
    try:
        yield path
    finally:
        _folder.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table or a scratch folder. Frames that still read it fail from then on."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where a result feeds several later steps: they then prune columns from a file that
    survives executor loss instead of recomputing the lineage.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
