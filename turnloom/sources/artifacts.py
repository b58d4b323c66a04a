"""JSON documents with fixed schemas. Absent keys are null; a byte order mark is tolerated."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.text import basename, known_place, safe_child

#: SRC-02. The file that holds each document of a video's folder.
FILES = {
    "meta": "meta.json", "asr": "asr.json", "diarization": "diarization.json", "diarization_reconciled": "diarization_reconciled.json", "visual_reconcile": "visual_reconcile.json",
    "segments_raw": "aligned_segments.json", "segments_gap_corrected": "aligned_segments_gap_corrected.json", "segments_corrected": "aligned_segments_corrected.json", "segments_final": "aligned_segments_final.json",
    "boundary_audit": "speaker_boundary_gap.json", "correction_audit": "speaker_correction.json", "speaker_summary": "speaker_summary.json", "speaker_table": "speaker_table.json", "speaker_map": "speaker_map.json",
    "emotion": "emotion_segments.json", "captions": "final_caption_data.json", "style": "caption_style.json",
}
SEGMENTS = "video_id string, segments array<struct<index:int, start:double, end:double, duration:double, speaker:string, text:string, num_words:int, overlap_sec:double, coverage:double, boundary_ambiguous:boolean, emotion:string, text_ko:string>>"

TURN = "struct<index:int, speaker:string, start:double, end:double, duration:double, speaker_audio:string, reconcile_source:string, reconcile_cov:double, reconcile_margin:double>"
SCHEMAS = {
    "diarization": f"speaker_turns array<{TURN}>, alignment_turns array<{TURN}>",
    "asr": "language string, text string, segments array<struct<id:int, start:double, end:double, text:string, words:array<struct<start:double, end:double, word:string, probability:double>>>>",
    "diarization_reconciled": f"speaker_turns array<{TURN}>, alignment_turns array<{TURN}>",
    "meta": "video_id string, title string, source_video string, audio struct<sample_rate:int, channels:int, duration_sec:double, frames:bigint>",
    **{kind: SEGMENTS for kind in ("segments_raw", "segments_gap_corrected", "segments_corrected", "segments_final", "emotion", "captions")},
    "style": "version int, position string",
    "speaker_map": "source_table string, speakers map<string,string>, rows array<struct<speaker_id:string, display_name:string, speaker_display:string, speaker_name:string, name:string, edited_name:string>>",
}


def read_documents(spark: SparkSession, kind: str, paths) -> DataFrame:
    """SRC-01, SRC-03: one row for each document, with the name of its folder as video_id."""
    docs = spark.read.schema(SCHEMAS[kind]).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
    return docs.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("video_id"), *docs.columns)


def read_bare_maps(spark: SparkSession, paths) -> DataFrame:
    """SRC-15: documents that are one map from id to name, as video_id and bare."""
    text = spark.read.text(paths, wholetext=True)
    return text.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("video_id"), F.from_json(F.regexp_replace("value", "^\ufeff", ""), "map<string,string>").alias("bare"))


def read_kind(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """SRC-02, SRC-10: the documents of a kind in all folders below root; an error where there is none, as with any path that doesn't exist."""
    return read_documents(spark, kind, f"{root}/*/{FILES[kind]}")


def versions(documents: dict[str, DataFrame]) -> DataFrame:
    """SRC-04 to 06: documents of several versions as one table with the version's name, for labels.latest()."""
    out = None
    for name, df in documents.items():
        df = df.withColumn("version", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def styles(documents: DataFrame) -> DataFrame:
    """SRC-16: version 2 and the place of each style document; the default place where it can't be read or isn't a preset."""
    return documents.select("video_id", F.lit(2).alias("version"), known_place(F.col("position")).alias("position"))


def path_context(path, known_files: DataFrame | None = None):
    """SRC-09: split and stem of .../audio/<split>/.../<stem>.<ending>; split is null for other paths."""
    split = F.nullif(F.regexp_extract(path, r"(?:^|/)audio/([^/]+)/(?:[^/]+/)*[^/]+$", 1), F.lit(""))
    return split, F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def with_side_files(audio: DataFrame, files: DataFrame) -> DataFrame:
    """SRC-09: audio(path) with split, stem, and the meta and rttm file beside it, of files(path) that exist."""
    root = F.regexp_extract("path", r"^(.*?)/?audio/[^/]+/", 1)
    split, stem = path_context(F.col("path"))
    a = audio.select("path", split.alias("split"), stem.alias("stem"), root.alias("root"))
    for kind, ending in (("meta", "json"), ("rttm", "rttm")):
        have = files.select(F.col("path").alias(kind))
        wanted = F.concat_ws("/", F.nullif("root", F.lit("")), F.lit(kind), "split", F.concat("stem", F.lit(f".{ending}")))
        a = a.join(have, F.col("split").isNotNull() & (wanted == F.col(kind)), "left")
    return a.drop("root")


def moved_path(path):
    """SRC-13: where a video is looked for that isn't at its own path: by its name among the videos; null without a name."""
    name = F.nullif(basename(F.coalesce(path, F.lit(""))), F.lit(""))
    return F.concat(F.lit("videos/"), name)


def library(meta: DataFrame, tables: DataFrame, emotion: DataFrame, videos: DataFrame, ready: DataFrame) -> DataFrame:
    """SRC-11, SRC-13, SORT-07: folders that have meta, speaker table and emotion documents and whose video exists: at its path, else by its name
    among videos(path). Title, duration, number of segments; sorted by name in lower case, so collect it or write it as it is."""
    m = meta.filter(safe_child(F.col("video_id")).isNotNull()).join(tables.select("video_id"), "video_id", "left_semi")
    n = emotion.select("video_id", F.coalesce(F.nullif("num_segments", F.lit(0)), F.size(F.coalesce("segments", F.array())), F.lit(0)).alias("num_segments"))
    at = videos.select(F.col("path").alias("there")).distinct()
    by_name = videos.select(moved_path(F.col("path")).alias("moved")).distinct()
    found = m.join(n, "video_id").join(at, F.col("source_video") == F.col("there"), "left").join(by_name, moved_path(F.col("source_video")) == F.col("moved"), "left")
    done = ready.select("video_id", F.lit(True).alias("ready"))
    out = found.withColumn("video", F.coalesce("there", "moved")).filter("video is not null").join(done, "video_id", "left")
    return out.select(
        "video_id", F.coalesce(F.nullif("title", F.lit("")), "video_id").alias("title"), "video", F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"), "num_segments", F.coalesce("ready", F.lit(False)).alias("ready"),
    ).orderBy(F.lower("video_id"), "video_id")


def turn_rows(documents: DataFrame) -> DataFrame:
    """PRJ-05: alignment_turns if there are any, else speaker_turns."""
    return documents.select("video_id", F.inline(picked_turns(F.col("alignment_turns"), F.col("speaker_turns"))))


def picked_turns(alignment, speaker):
    """PRJ-05: the first list if it has entries, else the second, else an empty one."""
    return F.when(F.size(alignment) > 0, alignment).otherwise(F.coalesce(speaker, F.array()))


def speaker_bounds(num, least, most):
    """PRJ-04: (lowest, highest) number of speakers: a given number is both; without limits 1 and 20."""
    return F.coalesce(num, least, F.lit(1)), F.coalesce(num, most, F.lit(20))


def normalised(documents: DataFrame) -> DataFrame:
    """PRJ-01: recognition documents with stripped texts and words, absent fields null, and counts."""
    from turnloom.functions.text import stripped

    word = lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["word"].alias("word"), w["probability"].alias("probability"))
    segment = lambda s: F.struct(s["id"].alias("id"), s["start"].alias("start"), s["end"].alias("end"), stripped(s["text"]).alias("text"), F.transform(F.coalesce(s["words"], F.array()), word).alias("words"))
    all_ = F.transform(F.coalesce("segments", F.array()), segment)
    n_words = F.aggregate(all_, F.lit(0), lambda a, s: a + F.size(s["words"]))
    return documents.select("video_id", "language", stripped(F.coalesce("text", F.lit(""))).alias("text"), all_.alias("segments"), F.size(all_).alias("num_segments"), n_words.alias("num_words"))


def word_rows(documents: DataFrame) -> DataFrame:
    """PRJ-02: words with the index they have in their segment; those without times are dropped."""
    s = documents.select("video_id", F.inline("segments"))
    w = s.select("video_id", F.col("id").alias("asr_segment_id"), F.posexplode("words").alias("word_index", "w")).select("video_id", "asr_segment_id", "word_index", "w.*")
    return w.filter(F.col("start").isNotNull() & F.col("end").isNotNull())
