"""What operators need of a Spark session: code on the workers, and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per Spark context.

    Functions given to mapInPandas and the like are pickled by name, so the workers must find their modules. Executors
    that join later fetch the archive from the driver as well.
    """
    context = spark.sparkContext
    if getattr(context, "_tessella_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="tessella-")) / "tessella.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    context.addPyFile(str(at))
    context._tessella_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that is unset, and only in local mode, a temporary folder takes its place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    own = getattr(context, "_tessella_dir", None)
    if own is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = context._tessella_dir = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return own


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that ran on it, and the optimizer knows the real size of
    what follows. The table is Parquet, so later stages read only the columns they need.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tessella/{uuid.uuid4().hex}"
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(at)
    out = spark.read.schema(df.schema).parquet(at) if not partition_by else spark.read.parquet(at)
    out._tessella_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote, once nothing reads them any more: what came of them has been written."""
    for t in tables:
        at = getattr(t, "_tessella_at", None)
        if at:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """df kept in memory and on disk for what reads it inside the with statement, as a dashboard's views do."""
    held = df.persist()
    try:
        yield held
    finally:
        held.unpersist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a directory of part files serves as well as a single file."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows. Reads no more than max_rows + 1 of them."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame) -> DataFrame:
    """df in enough partitions to keep all cores busy with per-row Python work.

    A table of many files already has them and stays as it is; only one that comes in fewer pieces than there are cores is
    dealt out by a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
