"""Emotions, display names and translations on segments, and what a video's captions are made of (OP-06 to OP-09)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import UNKNOWN_TAG, caption_text, display_prefix, parsed_tags, stripped
from turnloom.operators import asking, sequential
from turnloom.sources import sinks

#: Padding of the clip that an emotion is read from, and its least length.
PAD_MS, LEAST_MS = 200, 100


def clip_end(start_ms: Column, end_ms: Column) -> Column:
    """PRJ-11."""
    return F.greatest(start_ms + LEAST_MS, end_ms + PAD_MS)


def sample_range(start_ms: Column, end_ms: Column, rate: Column, n_samples: Column) -> tuple[Column, Column]:
    """PRJ-11, FN-18: first and last sample of a clip, within the recording."""
    at = lambda ms: F.floor(ms * rate / 1000)
    return F.greatest(F.lit(0), at(start_ms)), F.least(n_samples, at(end_ms))


def stub_emotion(segments: DataFrame) -> DataFrame:
    """PRJ-09."""
    return segments.withColumns({"emotion": F.lit(UNKNOWN_TAG), "emotion_transcript": F.lit(None).cast("string"), "emotion_backend": F.lit("stub")})


def read_emotion(segments: DataFrame, model: asking.Step, backend: str = "model") -> DataFrame:
    """OP-07: segments with clip_end_ms and what the model says (it adds emotion_raw, which may be null) taken apart."""
    raw = F.coalesce(F.col("emotion_raw"), F.lit(""))
    emotion, transcript = parsed_tags(raw)
    heard = model(segments.withColumn("clip_end_ms", clip_end(F.col("start_ms"), F.col("end_ms"))))
    return heard.withColumns({"emotion": emotion, "emotion_transcript": transcript, "emotion_backend": F.lit(backend)})


def untranslated(cues: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """PRJ-15: cues with text, and without a translation unless they are all to be done anew."""
    text = F.col("text").isNotNull() & (stripped(F.col("text")) != "")
    return cues.filter(text if overwrite else text & (F.coalesce("text_ko", F.lit("")) == ""))


def translated(cues: DataFrame, translate: asking.Step = asking.kept_as_is, *, batch: int = 40, overwrite: bool = False) -> DataFrame:
    """UDF-03, WIN-20, JOIN-12: cues(video_id, index, text, text_ko, ...) with translations by row; a row that the client leaves out stays as it was.

    The client gets video_id, index, text and the number of its batch of 40 in the video.
    """
    order = Window.partitionBy("video_id").orderBy("index")
    wanted = untranslated(cues, overwrite=overwrite).select("video_id", "index", stripped(F.col("text")).alias("text"), F.floor((F.row_number().over(order) - 1) / batch).alias("batch"))
    new = translate(wanted).select("video_id", "index", F.col("text_ko").alias("__new"))
    return cues.join(new, ["video_id", "index"], "left").withColumn("text_ko", F.coalesce("__new", "text_ko")).drop("__new")


#: The version of the rules by which cues are cut.
CUE_VERSION = 1


def cue_chain(segments: DataFrame, translate: asking.Step = asking.kept_as_is, *, batch: int = 40, overwrite: bool = False) -> DataFrame:
    """OP-08: segments (video_id, index, words, cue_version and what a caption needs) as translated cues, numbered anew in each video. Segments that are cues of this version already stay as they are."""
    own = [c for c in segments.columns if c not in ("video_id", "index", "start_ms", "end_ms", "text", "text_ko", "words", "num_words", "cue_version", "part", "part_count", "parent_index")]
    old = F.coalesce(F.col("cue_version"), F.lit(0)) == CUE_VERSION if "cue_version" in segments.columns else F.lit(False)
    fresh = segments.filter(~old)
    words = fresh.select("video_id", F.col("index").alias("parent_index"), F.posexplode("words").alias("word_index", "w")).select("video_id", "parent_index", "word_index", "w.start_ms", "w.end_ms", "w.word")
    cues = sequential.split_cues(words).join(fresh.select("video_id", F.col("index").alias("parent_index"), *own), ["video_id", "parent_index"])
    silent = fresh.filter(F.size(F.coalesce("words", F.array())) == 0)  # nothing to cut by
    one = F.lit(1).cast("bigint")
    silent = silent.select("video_id", F.col("index").alias("parent_index"), one.alias("part"), one.alias("part_count"), "start_ms", "end_ms", "text", F.lit(0).cast("bigint").alias("num_words"), *own)
    cues = cues.unionByName(silent)
    number = Window.partitionBy("video_id").orderBy("parent_index", "part")
    cues = cues.withColumns({"index": (F.row_number().over(number) - 1).cast("bigint"), "text_ko": F.lit(None).cast("string"), "cue_version": F.lit(CUE_VERSION)})
    kept = segments.filter(old).drop("words")
    return translated(cues.unionByName(kept, allowMissingColumns=True), translate, batch=batch, overwrite=overwrite)


def captions(cues: DataFrame, **switches) -> DataFrame:
    """PRJ-12, PRJ-13: cues with the caption that is shown."""
    prefix = display_prefix(F.col("speaker_id"), F.col("speaker_display"))
    return cues.withColumn("caption", caption_text(prefix, F.col("emotion"), F.col("text_ko"), F.col("text"), **switches))


def rendered(cues: DataFrame, **switches) -> DataFrame:
    """OP-09: one SRT document for each video."""
    return sinks.srt(captions(cues, **switches).withColumn("pos", F.col("index")))
