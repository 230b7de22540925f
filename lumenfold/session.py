"""Session helpers: the shared working folder, checkpoints and size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes up to which a side may be broadcast; beyond it every operator has another way.
BROADCAST_BOUND = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing and all executors are on this machine (as
    in tests) a temporary folder is made and registered, once per session.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = getattr(sc, "_lumenfold_dir", None)
        if at is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if at is None:
            folder = tempfile.mkdtemp(prefix="lumenfold-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            at = sc._lumenfold_dir = "file://" + folder
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


#: Paths that this process made in shared folders and that nobody has removed yet.
_SCRATCH: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is read from it lives until :func:`clean`."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.add(path)
    return path


def clean(spark: SparkSession) -> None:
    """Delete all scratch paths of this process: to be called once their results were taken."""
    for path in sorted(_SCRATCH):
        remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`scratch`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _SCRATCH.discard(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
