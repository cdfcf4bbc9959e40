"""Session helpers."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where nothing is set in a local session (as in tests) a temporary folder is taken; on a
    cluster that is an error, since executors do not share the driver's folders.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="keystrata-checkpoint-"))
    return sc.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nobody holds any more.

    Spark does so when the driver's collector finds them unreachable, which on an idle driver can
    take half an hour; an operator with several large phases calls this between them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
