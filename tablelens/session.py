"""Session helpers: a local session for tests and benches, and the shared
folder for lineage cuts (read from ``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: written tables of this driver that nobody has removed yet
_written: list[str] = []


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "tablelens") -> SparkSession:
    """Single-JVM session used by tests and bench.py. On a cluster, build the
    session the usual way; nothing here is required by the operators."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only when that is unset
    AND the master is local (tests, a laptop) do we pick a fresh local folder
    of our own. On a cluster an unset folder is an error, never a
    machine-local fallback.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach "
                               "(intermediate tables are written there)")
        path = tempfile.mkdtemp(prefix="tablelens-ckpt-")  # single machine only
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark)
    _written.append(os.path.join(base, "tablelens", f"{name}-{uuid.uuid4().hex}"))
    return _written[-1]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Own the intermediate tables written inside the ``with`` block: they are
    removed when it ends, so results must be saved (or collected) inside. Only
    paths that ``scratch_path`` gave out in the block are touched."""
    first = len(_written)
    try:
        yield
    finally:
        made = _written[first:]
        del _written[first:]
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
