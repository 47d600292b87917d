"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share.

    Only where the session names none (as in tests, where everything runs in
    one process) a temporary folder of this process is used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + _OWN.setdefault("dir", tempfile.mkdtemp(prefix="citegraph-"))


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: it is computed once, and a lost executor loses nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made and that nothing still to be computed reads."""
    for table in tables:
        system, path = _place(table.sparkSession, table._written_at)
        system.delete(path, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file of exactly this text, wherever Spark can write."""
    system, place = _place(spark, path)
    out = system.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place
