"""Session helpers: a tuned local session for tests/bench and the checkpoint dir."""

from __future__ import annotations

import contextlib
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "sievekit") -> SparkSession:
    """Local session used by tests and bench; clusters pass their own session."""
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only a local master may leave it unset: then a scratch folder is
    made, since driver and tasks share one disk.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="sievekit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, as ``--py-files`` would: kernels run in their workers."""
    sc = spark.sparkContext
    if getattr(sc, "_sievekit_shipped", False):
        return
    package = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="sievekit-ship-")) / "sievekit.zip"
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(where))
    sc._sievekit_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffle files as they end: for results that are written or collected and read from there on."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _on_path(spark: SparkSession, path: str, act):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return act(p.getFileSystem(sc._jsc.hadoopConfiguration()), p)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate table when the driver's JVM ends."""
    _on_path(spark, path, lambda fs, p: fs.deleteOnExit(p))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate table that no later step reads."""
    _on_path(spark, path, lambda fs, p: fs.delete(p, True))
