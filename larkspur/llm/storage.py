"""Where intermediate results go: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only a local master without one (as in tests) gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="larkspur-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder: later steps don't repeat it and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder, read again. ``forget`` deletes it once nothing reads it any more."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made."""
    for df in tables:
        remove(df.sparkSession, df._larkspur_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give this subpackage to the session's Python workers, once per application (a zip that Spark's file server hands out)."""
    sc = spark.sparkContext
    if getattr(sc, "_larkspur_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="larkspur-")) / "larkspur_llm.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in [top / "larkspur" / "__init__.py", *sorted(Path(__file__).resolve().parent.glob("*.py"))]:
            z.write(f, f.relative_to(top))
    sc.addPyFile(str(path))
    sc._larkspur_shipped = True
