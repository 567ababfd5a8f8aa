"""Session helpers shared by every layer."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine is written for; cluster jobs bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quernstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUERNSTONE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "64m")  # members come with the texts of all their parts
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that all machines share, as ``spark.checkpoint.dir`` names it.

    A private folder takes its place where the session names none and all of it runs on one machine (tests, a laptop);
    on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if master not in _PRIVATE:
        _PRIVATE[master] = tempfile.mkdtemp(prefix="quernstone-")
    return _PRIVATE[master]


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def tasks_for(spark: SparkSession, rows: int, most: int = 500_000) -> int:
    """Tasks of at most so many rows on average, and enough for all cores where there is work for them."""
    return max(1, -(-rows // most), min(spark.sparkContext.defaultParallelism, rows // 20_000))


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    if not package.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="quernstone-")) / "quernstone.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(target))


_SHIPPED: set[str] = set()
_PRIVATE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; every query begins here, so the executors have the package from then on."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
