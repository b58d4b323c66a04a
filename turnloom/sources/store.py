"""A library's folders: one for each video, with a file for each of its documents.

Files are written by Spark's tasks to a folder of their own, whose commit keeps a task that is tried twice from counting twice, and moved into place one by one by
renames that replace what is there. A reader sees a whole document or none, and a write that ends early leaves nothing but that folder, which the next one removes.

Where root is a folder of the system (`file:`), which driver and executors share, tasks write, move and look up files as such: Hadoop starts a chmod for each file
there, and a checksum beside it, which costs more than the file. In other stores Spark's writer makes them and the driver moves them.
"""

import json
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.text import safe_child
from turnloom.sources.artifacts import FILES

STAGING = "_writing"
READY = "ready.json"
#: Tasks for each core that write files, threads that move them into place, and characters of texts that a task gathers before it hands them on.
TASKS_A_CORE, MOVERS, HELD = 4, 16, 4 << 20
#: Bytes and rows of an Arrow batch of documents at most. A document can have many times an Arrow row's usual size, and a batch stands in the JVM and in a Python worker at once.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": HELD, "spark.sql.execution.arrow.maxRecordsPerBatch": 1000}


@contextmanager
def _small_batches(spark: SparkSession):
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


def _files(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _shared(spark: SparkSession, root: str) -> str | None:
    """root as a folder of the system, if it is one."""
    jvm, base, fs = _files(spark, root)
    return fs.makeQualified(base).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _indented(text: str) -> str:
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False)


def _put(top: str, indent: bool):
    """Writes each (video_id, file, body) to a file in a folder of this task's attempt below top; says where."""

    def run(batches):
        mine = os.path.join(top, uuid.uuid4().hex)
        os.makedirs(mine)
        n = 0
        for b in batches:
            rows = []
            for video, file, body in zip(*b.columns, strict=True):
                with open(f"{mine}/{n}", "wb") as out:
                    out.write(_indented(body.as_py()).encode() if indent else body.as_buffer())
                rows.append(json.dumps([video.as_py(), file.as_py(), f"{mine}/{n}"]))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

    return run


def _move(root: str):
    """Moves what _put() has written into place. A task that is tried again finds the files that it moved before gone from where they were."""

    def run(batches):
        for b in batches:
            n = 0
            for video, file, source in map(json.loads, b.column(0).to_pylist()):
                folder = os.path.join(root, video)
                os.makedirs(folder, exist_ok=True)
                if os.path.exists(old := f"{folder}/.{file}.crc"):  # Hadoop's checksum of what was there
                    os.unlink(old)
                if os.path.exists(source) or not os.path.exists(f"{folder}/{file}"):
                    os.replace(source, f"{folder}/{file}")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def _with_texts(batch: pa.RecordBatch, texts, name: str):
    """The rows of batch with the texts, (row, text) each, in batches that hold few of them."""
    at, held, size = [], [], 0
    for i, text in texts:
        at.append(i)
        held.append(text)
        size += len(text)
        if size >= HELD:
            yield batch.take(pa.array(at, pa.int64())).append_column(name, pa.array(held, pa.string()))
            at, held, size = [], [], 0
    yield batch.take(pa.array(at, pa.int64())).append_column(name, pa.array(held, pa.string()))


def compact(documents: DataFrame, columns: list[str], name: str = "body") -> DataFrame:
    """documents with `name`, the columns as a JSON text without white space, nulls kept; all other columns stay."""
    return documents.select(*[c for c in documents.columns if c not in columns], F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))


def pretty(documents: DataFrame, columns: list[str], name: str = "body") -> DataFrame:
    """SNK-01: documents with `name`, the columns as a JSON text with an indent of two, nulls and non-ASCII characters kept."""
    return _with_indent(compact(documents, columns, name), name)


def _with_indent(rows: DataFrame, name: str) -> DataFrame:
    """rows with the JSON texts of their last column, `name`, indented."""
    kinds = dict(rows.dtypes)
    keep = rows.columns[:-1]

    def run(batches):
        for b in batches:
            texts = ((i, _indented(x.as_py())) for i, x in enumerate(b.column(len(keep))))
            yield from _with_texts(b.select(range(len(keep))), texts, name)

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` string"]))


def write_documents(documents: DataFrame, root: str, *, ending: str = "}", indent: bool = False) -> int:
    """SNK-12, SNK-01, SNK-04: documents (video_id, file, body), each to root/video_id/file. Every body has to end with `ending`, as JSON objects and
    SRT texts (with a line feed) do; the number of files. Rows whose video_id is no plain name of a folder are an error; of several bodies of a file the greatest stays.
    indent: bodies are JSON texts as of compact(), and the tasks that write them give them pretty()'s form, so that the longer texts are never shuffled or sorted."""
    with _small_batches(documents.sparkSession):
        return _write_documents(documents, root, ending, indent)


def _write_documents(documents: DataFrame, root: str, ending: str, indent: bool) -> int:
    spark = documents.sparkSession
    jvm, base, fs = _files(spark, root)
    staging = jvm.org.apache.hadoop.fs.Path(base, STAGING)
    mine = jvm.org.apache.hadoop.fs.Path(staging, uuid.uuid4().hex)
    video = F.col("video_id").cast("string")
    sound = F.when(safe_child(video).isNull(), F.raise_error(F.concat(F.lit("no name of a folder: "), F.coalesce(video, F.lit("null"))))).when(~F.col("body").endswith(ending), F.raise_error(F.concat(F.lit("a body without its ending: "), video))).otherwise(F.col("body"))
    # files cost more than bytes: as many tasks as the cluster has cores a few times over, whatever their size
    tasks = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    one = documents.select(video.alias("video_id"), "file", "body").repartition(tasks, "video_id").groupBy("video_id", "file").agg(F.max("body").alias("body"))
    shared = _shared(spark, root)
    try:
        if shared is not None:
            top = _shared(spark, mine.toString())
            fs.mkdirs(mine)
            made = one.select("video_id", "file", sound.alias("body")).mapInArrow(_put(top, indent), "value string")
            made.write.text(f"{mine.toString()}/_made")
            return spark.read.text(f"{mine.toString()}/_made").mapInArrow(_move(shared), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # Spark's own line end closes each file; nobody reads the folder before the write is done, so tasks commit their files themselves
        one = _with_indent(one.select("video_id", "file", sound.alias("body")), "body") if indent else one
        rows = one.select("video_id", "file", F.substring(sound, F.lit(1), F.length("body") - len(ending)).alias("value"))
        rows.write.option("lineSep", ending).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("video_id", "file").text(mine.toString())
        made = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.globStatus(jvm.org.apache.hadoop.fs.Path(mine, "*/*/part-*")))
        top = fs.makeQualified(mine).toString() + "/"
        text = jvm.org.apache.commons.lang3.ArrayUtils.toString(made)  # {path,path}, in one call
        sources = text[1 + len(top) : -1].split("," + top) if len(made) else []
        overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())

        def move(source: str) -> None:
            folder, file = (unquote(part.split("=", 1)[1]) for part in source.split("/")[:2])
            target = jvm.org.apache.hadoop.fs.Path(base, folder)
            fs.mkdirs(target)
            context.rename(jvm.org.apache.hadoop.fs.Path(mine, source), jvm.org.apache.hadoop.fs.Path(target, file), overwrite)

        with ThreadPoolExecutor(MOVERS) as movers:
            return sum(1 for _ in movers.map(move, sources))
    finally:
        fs.delete(mine, True)


def clear_unfinished(spark: SparkSession, root: str) -> None:
    """Removes what writes that were killed have left; call it where none is under way."""
    jvm, base, fs = _files(spark, root)
    fs.delete(jvm.org.apache.hadoop.fs.Path(base, STAGING), True)


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """SRC-02, SRC-03, SRC-10: split (null without one), video_id, kind, path, length of every known document in root/video or root/split/video. The listing is Spark's; no file is read."""
    known = F.create_map(*[F.lit(x) for kind, file in FILES.items() for x in (file, kind)])
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root).select("path", "length")
    jvm, base, fs = _files(spark, root)
    top = fs.makeQualified(base).toUri().getPath().rstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + _quoted(top) + "/", "")
    parts = F.split(below, "/")
    rows = listed.withColumn("parts", parts).filter(F.size("parts").between(2, 3) & ~F.get("parts", F.lit(0)).startswith("_"))
    return rows.select(
        F.when(F.size("parts") == 3, F.get("parts", F.lit(0))).alias("split"), F.element_at("parts", -2).alias("video_id"), known[F.element_at("parts", -1)].alias("kind"), "path", "length"
    ).filter("kind is not null")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else "\\" + c for c in text)


def missing(documents: DataFrame, kinds: list[str]) -> DataFrame:
    """SRC-10: split, video_id and the kinds that the video hasn't, of the videos that lack any; documents: catalog()'s."""
    have = documents.groupBy("split", "video_id").agg(F.collect_set("kind").alias("kinds"))
    lack = F.array_except(F.array(*map(F.lit, kinds)), "kinds")
    return have.select("split", "video_id", lack.alias("missing")).filter(F.size("missing") > 0)


def read_all(spark: SparkSession, root: str, kind: str, *, split: str | None = None) -> DataFrame:
    """SRC-02, SRC-03: the documents of a kind, of one split or of the folders right below root; only their paths are listed. An error that names the file where there is none."""
    from turnloom.sources.artifacts import read_documents

    pattern = f"{root.rstrip('/')}/{split + '/' if split else ''}*/{FILES[kind]}"
    jvm, path, fs = _files(spark, pattern)
    if not fs.globStatus(path):
        raise FileNotFoundError(f"no {FILES[kind]} in the folders of {pattern.rsplit('/', 2)[0]}")
    return read_documents(spark, kind, pattern)


def with_file(videos: DataFrame, root: str, file: str = READY, *, text: str | None = None) -> DataFrame:
    """SNK-09: the rows of videos (video_id) whose folder below root has the file, with what it says in a column text if that is named. Where root is a folder of the system, tasks look up each video and nothing is listed."""
    spark = videos.sparkSession
    shared = _shared(spark, root)
    folder = F.col("video_id").cast("string")
    if shared is None:
        pattern = f"{root.rstrip('/')}/*/{file}"
        jvm, path, fs = _files(spark, pattern)
        found = [s.getPath().getParent().getName() for s in fs.globStatus(path) or []]
        if not text or not found:
            there = spark.createDataFrame([(x,) for x in found], "__folder string")
            there = there.withColumn(text, F.lit(None).cast("string")) if text else there
        else:
            there = spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("__folder"), F.col("value").alias(text))
        return videos.join(there, folder == F.col("__folder")).drop("__folder")
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in videos.dtypes), *([f"`{text}` string"] if text else [])])

    def found_in(names):
        for i, v in enumerate(names):
            if v is not None and (path := Path(shared, v, file)).exists():
                yield i, path.read_bytes().decode() if text else ""

    def run(batches):
        for b in batches:
            for part in _with_texts(b.drop_columns(["__folder"]), found_in(b.column("__folder").to_pylist()), "__text"):
                yield part.rename_columns([*part.schema.names[:-1], text]) if text else part.drop_columns(["__text"])

    return videos.select("*", folder.alias("__folder")).repartition(spark.sparkContext.defaultParallelism, "video_id").mapInArrow(run, schema)


def body(value: Column, ending: str = "") -> Column:
    return F.concat(value, F.lit(ending))
