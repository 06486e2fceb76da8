"""Spark session helpers.

Library code never hard-codes a scratch location: lineage is cut with
``DataFrame.checkpoint()`` into the folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent *and* the
master is local (tests, laptops) do we create one under the system temp
folder.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (Arrow batches pickle
    functions by module), like ``--py-files``: zipped and added once per
    application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    out = tempfile.mkdtemp(prefix="siftwork-pyfiles-")
    sc.addPyFile(shutil.make_archive(os.path.join(out, "siftwork"), "zip", root_dir=ROOT, base_dir="siftwork"))
    _SHIPPED.add(sc.applicationId)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "siftwork") -> SparkSession:
    """Session with the settings every plan in this package assumes."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    parts = shuffle_partitions or int(os.environ.get("SIFTWORK_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SIFTWORK_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a home and return it.

    Order: an already-set SparkContext checkpoint dir, then the session
    setting ``spark.checkpoint.dir``; a private temp folder only for a local
    master (a machine-local folder is never valid on a cluster).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local_dir = tempfile.mkdtemp(prefix="siftwork-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, the same for every
    application (``ensure_checkpoint_dir`` gives a folder of this application)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named or ensure_checkpoint_dir(spark)


def stored_once(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there: for small
    tables that several parts of a plan read.  Nothing stays in executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_once(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the checkpoint folder and read from
    there.  For loops: a checkpoint keeps the size that was estimated for its plan,
    which joins multiply from round to round; a table has its own size."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
