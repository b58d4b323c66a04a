"""Where operators put intermediate tables: the folder that all executors share."""

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the one given to setCheckpointDir; where neither is set, one of our own, with a local master only."""
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base and (own := context._jsc.sc().getCheckpointDir()).isDefined():
        base = own.get()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/turnloom-checkpoints"
        context.setCheckpointDir(base)
    return base.rstrip("/")


#: Bytes and rows of an Arrow batch at most. Each batch stands in the JVM and in a Python worker at once, in buffers that double as they grow.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 2000}


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of BATCH, or of the session's own settings where those are smaller, for the actions inside; the settings are put back after them."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, most in BATCH.items():
            if not (before[k] or "").isdigit() or not 0 < int(before[k]) <= most:  # 0: no limit
                spark.conf.set(k, str(most))
        yield
    finally:
        for k, own in before.items():
            spark.conf.unset(k) if own is None else spark.conf.set(k, own)


#: Paths of the tables made by written(), in order.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/turnloom-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for x in paths:
        path = jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(conf).delete(path, True)


def discard(df: DataFrame) -> None:
    """Removes the files of a table made by written(), once nothing reads it any more."""
    _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def mark() -> int:
    return len(_made)


def discard_since(spark: SparkSession, since: int, *, but: DataFrame | None = None) -> None:
    """Removes all tables made after mark() gave `since`, but one: what a lazy result needed, once the result is written."""
    keep = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in but.inputFiles()} if but is not None else set()
    gone = [p for p in _made[since:] if p.rsplit("/", 1)[-1] not in keep]
    _made[since:] = [p for p in _made[since:] if p not in gone]
    _delete(spark, gone)


#: Rows of ids that are broadcast at most (32 MB of longs).
MOST_IDS = 4_000_000


def sized(ids: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """ids, to be broadcast in a join if they are counted to be few enough; else the join shuffles."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
