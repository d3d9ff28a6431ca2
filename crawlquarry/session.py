"""Session helpers: table access, durable intermediate tables, parallelism."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, wherever they run; once for each application.

    Functions that run on workers refer to their modules, and a worker doesn't share the driver's path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).parent
    # The driver serves the file to the executors, so it stays as long as the driver does.
    folder = tempfile.mkdtemp(prefix="crawlquarry-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "crawlquarry.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is configured (tests, local mode)."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    own = f"file://{tempfile.mkdtemp(prefix='crawlquarry-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage, survives the loss of executors, and keeps column pruning for
    later readers. The folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions for explicit repartitioning, at least one per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy Python stages one task per core at least.

    Inputs that are already split finely enough pass through without a shuffle, so
    this only costs anything when the whole input is a few files.
    """
    spark = df.sparkSession
    ship(spark)
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism * 2, *keys)


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Broadcast hint for a side whose row count is measured to be within ``max_rows``."""
    from pyspark.sql import functions as F

    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df), True) if small else (df, False)
