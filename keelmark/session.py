"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


#: The folder that this package lies in.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def build_session(app: str = "keelmark", master: str | None = None, **conf: object) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


#: The folder of local sessions that have no ``spark.checkpoint.dir``, once one was needed.
_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, which goes
    when the program ends: on a cluster a machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    # Kept here, as a running session does not take the setting.
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="keelmark-"))
        atexit.register(shutil.rmtree, _local_folder[0], ignore_errors=True)
    return _local_folder[0]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Boosting cuts its lineage with reliable checkpoints, which need a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


#: Paths that ``new_folder`` gave out in this program and ``remove_folders`` has not yet deleted.
_folders: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any file system; whether it was there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_folders(spark: SparkSession) -> int:
    """Delete what this program wrote to paths of ``new_folder``, wherever they are; the number of folders that were there.

    Results that are computed from these folders must have been written before.
    """
    removed = 0
    while _folders:
        removed += remove_path(spark, _folders[-1])
        _folders.pop()
    return removed
