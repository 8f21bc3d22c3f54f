"""Session helpers: building a local session for tests/bench, and the shared
scratch folder every job that must cut lineage or stage files writes into.

On a cluster the scratch root is ``spark.checkpoint.dir`` (a shared folder the
cluster names). Only when that setting is missing -- local runs and tests --
do we create our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "stationflow") -> SparkSession:
    """Session for tests and the local benchmark (no UI, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "Europe/Madrid")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


#: Bytes of a batch that a Python worker gets at once (Spark's own value is 64 MB, which JVM and worker both hold).
BATCH_CONF, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20, "67108864b"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application, and bound the
    batches that they get, unless the session has a bound of its own.
    The zip is only what the driver uploads: Spark serves it to the executors."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_CONF, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    if getattr(sc, "_stationflow_shipped", None) == sc.applicationId:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stationflow-zip-"), "stationflow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._stationflow_shipped = sc.applicationId


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a local one only when none is configured."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            # A machine-local folder is invisible to other executors and lost with them.
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
        # Local runs and tests only: a cluster names a shared folder here.
        root = tempfile.mkdtemp(prefix="stationflow-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


#: Scratch folders made inside each open ``scratch_scope``, the innermost last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for staged tables."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/stationflow/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through its own file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch folders that are made inside go at its end: for jobs whose result is written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete_path(spark, path)


def cut_lineage(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and
    read it back: later steps (and a retry after a lost executor) start from
    the stored copy instead of replaying the loop. One job, no recompute (an
    RDD checkpoint would compute the plan twice); never a local checkpoint.
    ``options`` are those of the Parquet writer."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)
