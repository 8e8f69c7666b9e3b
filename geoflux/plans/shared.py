"""The folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where it is unset and all runs in one process (tests), a temporary
    folder is made, set, and deleted at exit; on a cluster without the setting this fails."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        made = sc._jsc.sc().getCheckpointDir()
        where = made.get() if made.isDefined() else None
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        where = "file://" + path
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, wherever Hadoop finds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Lazy frames read their tables until the application ends; then the folder goes, if the session still runs."""

    def gone() -> None:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                delete(spark, path)

    atexit.register(gone)
