"""Session construction and checkpointing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Adaptive execution does the run-time work the operators rely on: it
# broadcasts a join side only after its shuffled size is known, splits skewed
# join partitions and coalesces small ones.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(
    app: str = "loregraph", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """Build or fetch a session; a cluster passes its own master and conf."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``.  Only
    a local master without that setting gets a temporary folder; on a cluster
    a machine-local folder would be lost together with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{sc.applicationId}"
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    temporary = tempfile.mkdtemp(prefix="loregraph-ckpt-")
    atexit.register(shutil.rmtree, temporary, True)
    sc.setCheckpointDir(temporary)
    return sc.getCheckpointDir()


# Of Spark: whether the shuffle files of a query go when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` as a table to the shared checkpoint folder and read that.

    For results used more than once.  Unlike an RDD checkpoint the files are
    columnar, so later readers fetch only the columns they need, and their
    size is known when joins are planned.  With ``free`` the shuffle files of
    this write go at once, not when the driver happens to collect its garbage;
    where Spark lacks the setting, they stay until then.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, "false") if free else None
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in workers import it, and on a cluster, or with a
    driver started from another folder, it would not be found there.
    """
    sc = spark.sparkContext
    if getattr(sc, "_loregraph_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="loregraph-zip-")
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/loregraph.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._loregraph_shipped = True


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables written by ``cut_lineage`` in this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/tables")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions, for steps that must not be coalesced."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
