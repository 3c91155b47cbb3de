"""Session construction and the shared folder for lineage cuts and sinks."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "tessera", conf: dict | None = None) -> SparkSession:
    """A session with AQE on (runtime coalescing and skew-join splitting) and no UI.

    On a cluster the master and partition counts come from the submitter; the
    defaults here are for local runs and tests.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    # One core per task already: keep NumPy's BLAS single-threaded in workers.
    for var in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(var, "1")
        b = b.config(f"spark.executorEnv.{var}", os.environ[var])
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        b = b.config(k, str(v))
    # Local mode runs everything in the driver JVM, whose default heap is 1 GB;
    # on a cluster the submitter sizes driver and executors, not this code.
    mem = os.environ.get("TESSERA_DRIVER_MEMORY") or ("12g" if (master or "").startswith("local") else None)
    if mem:
        b = b.config("spark.driver.memory", mem)
    spark = b.getOrCreate()
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Where it is unset, a local master (one machine, as in
    tests) gets a folder of its own, removed at exit; on a cluster every executor
    would write to its own disk, so that raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")
