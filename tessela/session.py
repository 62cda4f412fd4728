"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are written for; a cluster's own values win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8, app: str = "tessela") -> SparkSession:
    """A local session for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    return b.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that they need no copy of it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_tessela_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessela-")  # read by this driver only, which serves it to the executors
    archive = os.path.join(folder, "tessela.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._tessela_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table NAME of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for work that is dear per row: only where the scan gives work to at most half of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only where it is unset and the session is local (tests) is a folder of our own made, as its one process reads and
    writes it; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", "") or getattr(sc, "_tessela_folder", "")
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = sc._tessela_folder = os.path.join(tempfile.gettempdir(), f"tessela-checkpoints-{uuid.uuid4().hex}")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder; one that the session has set already is kept."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
