"""A local session for tests and benchmarks. On a cluster the session comes from outside."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidepanel")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the cluster's checkpoint folder and go on from there.

    ``spark.checkpoint.dir`` names a shared folder on a cluster. Only a local session without that setting,
    as in tests, gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidepanel-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows over all shuffle partitions by ``keys``.

    Model fits are few bytes and much work. An explicit partition count keeps adaptive execution from merging
    them into few tasks; a grouped fit by the same keys then needs no further shuffle.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; local workers too start in any folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tidepanel-")) / "tidepanel.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, str(Path(package.name) / file.relative_to(package)))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)
