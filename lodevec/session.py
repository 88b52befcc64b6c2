"""Session helpers: a local session, table loading, lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_folder: str | None = None


def local_session(cpus: int | str = "*", shuffle: int = 8, memory: str = "8g", name: str = "lodevec") -> SparkSession:
    """A session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, spread over the cores, for work that is long beside its input.

    Large tables have more partitions than cores and are left as they are: then nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and go on from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that
    is unset (tests, a single machine) a temporary one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(place or _own_folder())
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables that several executors write and read."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (place or _own_folder()).rstrip("/")


def _own_folder() -> str:
    """A folder of this process, deleted at its end: only where the cluster names none."""
    global _folder
    if _folder is None:
        _folder = tempfile.mkdtemp(prefix="lodevec-")
        atexit.register(shutil.rmtree, _folder, ignore_errors=True)
    return _folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
