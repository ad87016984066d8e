"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "trellis") -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes.

    AQE is on so that shuffle partitions coalesce and skewed sort-merge joins
    split at run time; the UI stays off; the session time zone is UTC so that
    event-time windows do not depend on the host.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    # several partitions per core: text scoring is CPU-heavy per row and
    # document lengths vary widely, so one partition per core leaves stragglers
    parts = shuffle_partitions or int(os.environ.get("TRELLIS_SHUFFLE_PARTITIONS", str(4 * cpus)))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionNum", str(parts))
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRELLIS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset and
    all work runs in this process (a ``local[...]`` master) is a scratch folder
    chosen here: on a cluster it would be another disk on each machine.
    """
    try:
        conf_path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
    except Exception:  # no SparkContext access (e.g. Spark Connect)
        conf_path, master = None, ""
    path = conf_path or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="trellis-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:
        pass
    return path


def run_folder(spark: SparkSession) -> str:
    """This application's folder for written tables, inside the shared checkpoint
    folder; :func:`remove_run_tables` removes it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/trellis/{spark.sparkContext.applicationId}"


def remove_run_tables(spark: SparkSession) -> bool:
    """Delete all tables this application has written for its own use. For the end of
    a run: DataFrames that read such a table cannot be evaluated afterwards. Homes of
    streams that the caller named lie elsewhere and stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for written tables inside the application's shared folder."""
    return f"{run_folder(spark)}/tables/{name}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, so that every
    later use sees the same rows and survives lost executors."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``trellis`` importable in the Python workers (UDFs, pandas
    operators): zip it once per SparkContext and register it with
    ``addPyFile``, which serves the archive to the executors."""
    import shutil

    try:
        sc = spark.sparkContext
    except Exception:  # no SparkContext access: artifacts are the session's business
        return
    ensure_checkpoint_dir(spark)
    if id(sc) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="trellis-pkg-")
    archive = shutil.make_archive(os.path.join(out, "trellis"), "zip", os.path.dirname(pkg), "trellis")
    sc.addPyFile(archive)
    _SHIPPED.add(id(sc))
