"""What jobs need on a cluster: tables in the folder that driver and executors share, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where the session names none and is one machine's."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table there and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tessera_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote. Nothing that is still to be computed may read them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._tessera_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per session, so that tasks import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_tasks.zip")
    with zipfile.ZipFile(at, "w") as z:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    z.write(path, os.path.join("tessera", os.path.relpath(path, root)))
    sc.addPyFile(at)
    sc._tessera_shipped = True
