"""Cuts long lineages: what several later steps read is computed once."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def own_folder(spark, name: str) -> str:
    """A new path below the folder that all executors share."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        _checked(spark)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{folder.get().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder of spark.checkpoint.dir (or the one that is set already); it survives lost executors. With a local master a folder of its own will do.

    A checkpoint would be computed twice and written as it stands in memory; of a table, steps read the columns they need. The folder's owner removes it."""
    _checked(df.sparkSession)
    path = own_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are broadcast at most.
MOST_ROWS = 100_000


def sized(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """rows, to be broadcast in a join if they are counted to be few enough; else the join shuffles."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _checked(spark) -> None:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.gettempdir() + "/turnloom-checkpoints")
