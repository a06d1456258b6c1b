"""Session helpers: a tuned builder for local runs and the checkpoint folder rule.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it.  A private checkpoint folder is created only
when the setting is unset *and* the master is local (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Tunables read from the session conf (all optional).
CONF_CHUNK_ROWS = "sparkseries.chunkRows"  # rows per ordered chunk (halo windows)
CONF_BROADCAST_ROWS = "sparkseries.broadcastMaxRows"  # size bound for broadcast sides
CONF_BROADCAST_BYTES = "sparkseries.broadcastMaxBytes"  # ... and its byte bound (JSON text size)

DEFAULT_CHUNK_ROWS = 1 << 20
DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 128 * 1024 * 1024

#: Bytes of an Arrow batch that a Python worker gets: rows that hold a run of points each (pieces of a
#: series) would otherwise arrive 10,000 at a time.
CONF_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MAX_BATCH_BYTES = 16 * 1024 * 1024


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "sparkseries") -> SparkSession:
    """Local/test session with AQE, UTC and the UI off."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus) * 2
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARKSERIES_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``sparkseries`` importable in Python workers (pandas UDFs, grouped maps) for
    local masters (tests, notebooks).  On a cluster the package is deployed like any
    library (installed on the executors or passed with ``--py-files``); nothing is
    staged in a machine-local folder there."""
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        return
    if getattr(sc, "_sparkseries_shipped", False) or sc.getConf().get("sparkseries.shipped", "") == "true":
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="sparkseries-pkg-")
    archive = shutil.make_archive(os.path.join(out, "sparkseries"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="sparkseries")
    sc.addPyFile(archive)
    sc._sparkseries_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a private one only for local masters.

    Also ships the package to the Python workers once per context, bounds the bytes of
    their batches and pins the SQL session time zone to UTC: every time in the long layout
    is zone-free (TIMESTAMP_NTZ) and epoch arithmetic must not shift with the session zone."""
    sc = spark.sparkContext
    ship_package(spark)
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if not 0 < conf_bytes(spark, CONF_BATCH_BYTES, 0) <= MAX_BATCH_BYTES:
        spark.conf.set(CONF_BATCH_BYTES, str(MAX_BATCH_BYTES))
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared (cluster-visible) folder")
    path = tempfile.mkdtemp(prefix="sparkseries-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    value = spark.conf.get(key, None)
    return int(value) if value not in (None, "") else default


def conf_bytes(spark: SparkSession, key: str, default: int) -> int:
    """A size in bytes; the default where it is unset or written with a unit."""
    value = spark.conf.get(key, None) or ""
    return int(value) if value.lstrip("-").isdigit() else default


def checkpoint(df):
    """Reliable checkpoint in the session's shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Like a reliable checkpoint it cuts the lineage and survives lost executors; unlike one it also
    forgets the plan's size estimate, which multiplies from round to round of an iteration."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/series/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
