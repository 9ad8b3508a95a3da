"""Session helpers: table access, durable lineage cuts, size-checked broadcasts and shipping of the package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes by the optimizer's estimate, that is ever broadcast by hint.
BROADCAST_BYTES = 32 * 1024 * 1024


def ship(spark: SparkSession) -> None:
    """Makes the package importable by Python workers wherever they run; once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_factloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))  # the driver serves it to every worker
    sc._factloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, from spark.checkpoint.dir.

    Where the session names none, a temporary folder serves a master on this machine alone; on a cluster it raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        where = f"file://{tempfile.gettempdir()}/factloom-checkpoints"
    return where


def stored(df: DataFrame, label: str) -> DataFrame:
    """Lineage cut by a written table in the shared folder; columnar, so later reads prune.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a frame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only while the estimated size stays under the limit; else the plain frame."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df
