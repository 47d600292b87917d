"""Where intermediate tables go, and small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.sources.scratch import discard, shared_folder, written

__all__ = ["BLANKS", "broadcast_if_small", "by_value", "discard", "documents", "release", "shared_folder", "small_batches", "written"]

#: ASCII white space as the contracts have it: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"\x20\x09-\x0D"
#: Rows and bytes that a Python worker is sent at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A hint to broadcast `df`, a narrow table of ids, if it has at most `rows` rows; else `df`, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(df: DataFrame) -> DataFrame:
    """`df`; from now on its session sends Python workers at most BATCH_ROWS rows and BATCH_BYTES bytes at once.

    Both sides of the pipe hold whole batches of texts, so Spark's own 10,000 rows cost
    some hundred megabytes for each core.  Smaller bounds that the session has stay.
    """
    conf = df.sparkSession.conf
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(size).lower()
    if not (now.rstrip("b").isdigit() and int(now.rstrip("b")) <= BATCH_BYTES):
        conf.set(size, str(BATCH_BYTES))
    return df


def release(*tables: DataFrame) -> None:
    """Discard `tables` and have the driver collect its garbage: until then it keeps its memory, and Spark the shuffle files that nothing refers to any more."""
    discard(*tables)
    for table in tables[:1]:
        table.sparkSession._jvm.System.gc()


def by_value(module: str) -> None:
    """Let workers receive the functions of `module` themselves, so that they need not find the package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])


# What the operators' modules refer to goes with them.
for _name in (__name__, "citegraph.sources.scratch"):
    by_value(_name)
