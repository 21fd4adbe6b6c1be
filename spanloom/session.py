"""Session helpers: a tuned session, durable cuts of the lineage, joins that survive hot keys."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the session is given by whoever submits."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own, or a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spanloom-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver found it, whatever their working directory is.

    On a cluster whose machines don't share that path, submit the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


#: Checkpoints that are still there, in the order they were made: session and file.
_kept: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder; survives the loss of executors.

    The file stays until `release`, `temporary` or the end of the program deletes it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    held = df.checkpoint()
    file = held._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _kept.append((df.sparkSession, file.get()))
    return held


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the shared folder, deleted like a checkpoint."""
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4()}"
    _kept.append((spark, path))
    return path


def release(since: int = 0) -> int:
    """Deletes checkpoints and says how many. DataFrames that read them can't be run any more."""
    gone = 0
    while len(_kept) > since:
        spark, file = _kept.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            gone += 1
        except Exception:  # noqa: BLE001  the session has ended; its folder is the cluster's to clean
            continue
    return gone


@contextmanager
def temporary() -> Iterator[None]:
    """Checkpoints made within are deleted at the end; what is computed from them must have been written by then."""
    since = len(_kept)
    try:
        yield
    finally:
        release(since)


atexit.register(release)


def join_by_count(big: DataFrame, counts: DataFrame, keys: list[str], weight: str, total: int, hot_keys: int = 1000) -> DataFrame:
    """Inner join of `big` with `counts`, which has one row per key and in `weight` the rows of that key in `big`.

    Keys holding at least 1/hot_keys of `total` rows go through a broadcast of at most `hot_keys`
    rows, a bound that follows from the weights' sum; all others are shuffled, where none of them
    can fill more than that share of the rows. Nothing is dropped. Keys must not be null.
    """
    counts = cut(counts)  # read three times
    limit = max(1, -(-total // hot_keys))
    hot = counts.where(F.col(weight) >= limit)
    few = F.broadcast(hot)
    cold_big = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return big.join(few, keys).unionByName(cold_big.join(counts.where(F.col(weight) < limit), keys))
