"""The Spark session that tests, the benchmark and local runs use."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A UTC session on one machine. On a cluster, pass the session that the cluster made instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application, so that they need no installed copy."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        held = Path(tempfile.mkdtemp(prefix="pagewright")) / "pagewright.zip"
        with zipfile.ZipFile(held, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(Path("pagewright") / f.relative_to(root)))
        sc.addPyFile(str(held))
        _shipped.add(sc.applicationId)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (spark.checkpoint.dir). Where that is unset, a session on one machine (tests,
    a laptop) gets a temporary one; on a cluster it has to be set, as executors do not share the driver's disk."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagewright"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared checkpoint folder and read again, for use between rounds of a loop."""
    folder = f"{checkpoint_folder(df.sparkSession)}/pagewright-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
