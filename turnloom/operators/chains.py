"""OP-12: a library of videos from words and turns to captions, for all videos at once."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators import asking, captions, correction, labels
from turnloom.operators import intervals as I
from turnloom.operators._kept import kept
from turnloom.sources import sinks, store


def prepared(
    words: DataFrame, turns: DataFrame, faces: DataFrame | None = None, names: DataFrame | None = None, *, judge: asking.Step = asking.rule_judge, span_judge: asking.Step = asking.rule_span_judge,
    verify: asking.Step = asking.rule_verifier, translate: asking.Step = asking.kept_as_is, emotion: asking.Step | None = None, top_k: int = 8,
) -> dict[str, DataFrame]:
    """Tables by name: turns (reconciled if there are faces), segments, gap_corrected, final, summary, emotion, captions, srt, and the audits.

    Stages that several later ones read are kept as tables. Videos whose faces tell nothing keep their audio labels.
    """
    out = {"turns": kept(labels.reconcile(turns, faces)) if faces is not None else turns}
    out["segments"] = kept(I.segments(I.assign(words, out["turns"])))
    out["gap_corrected"], out["boundary_audit"] = correction.repair_segments(out["segments"], span_judge)
    done = correction.correct_segments(out["gap_corrected"], judge, verify)
    out |= {"final": kept(done.segments), "proposals": done.proposals, "candidates": done.candidates, "borders": done.borders}
    out["summary"] = labels.speaker_summary(out["final"].withColumn("pos", F.col("index")), top_k=top_k)
    out["emotion"] = captions.read_emotion(out["final"], emotion) if emotion else captions.stub_emotion(out["final"])
    named = labels.apply_names(out["emotion"], names if names is not None else labels.map_template(out["summary"]).select("speaker_id", "display_name").distinct())
    out["captions"] = captions.cue_chain(named, translate)
    out["srt"] = captions.rendered(out["captions"])
    return out


def _per_video(rows: DataFrame, name: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row for each video with its rows as an array, in order."""
    return rows.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*columns).alias("__row")))), lambda x: x["__row"]).alias(name))


def prepare_library(words: DataFrame, turns: DataFrame, media: DataFrame, root: str, *, overwrite: bool = False, **steps) -> DataFrame:
    """OP-12 with SNK-09: the documents of every video of media (video_id, source_video) below root; video_id, status (ready, skipped, failed) and error of each.

    Videos with a marker are skipped, whole, unless overwrite. The others are done together, whatever an earlier run that ended early has left of them; their
    files replace what is there, one by one, and the markers come last, so a video with a marker has all its documents. A video without words or turns
    fails alone. steps: as for prepared().
    """
    ids = media.select("video_id")
    done = kept(store.with_file(ids, root)) if not overwrite else ids.limit(0)
    todo = media.join(done, "video_id", "left_anti")
    has = lambda rows: rows.select("video_id").distinct()
    error = F.when(F.col("words").isNull(), "no words").when(F.col("turns").isNull(), "no turns")
    state = todo.join(has(words).withColumn("words", F.lit(True)), "video_id", "left").join(has(turns).withColumn("turns", F.lit(True)), "video_id", "left").select("video_id", "source_video", error.alias("error"))
    state = kept(state)
    sound = state.filter("error is null").select("video_id")
    if not sound.isEmpty():
        out = prepared(words.join(sound, "video_id", "left_semi"), turns.join(sound, "video_id", "left_semi"), **steps)
        out["captions"] = kept(out["captions"])
        table = _per_video(out["summary"], "speakers", ["speaker"], out["summary"].drop("video_id").columns)
        table = has(out["final"]).join(table, "video_id", "left").withColumn("speakers", F.coalesce("speakers", F.array()))  # where nobody is known, an empty one
        segments = ["index", "speaker", "start_ms", "end_ms", "text"]
        documents = {
            "meta.json": (state.join(sound, "video_id", "left_semi").select("video_id", F.col("video_id").alias("id"), "source_video"), ["id", "source_video"]),
            "aligned_segments_final.json": (_per_video(out["final"], "segments", ["index"], [*segments, "words"]), ["segments"]),
            "speaker_table.json": (table, ["speakers"]),
            "emotion_segments.json": (_per_video(out["emotion"], "segments", ["index"], [*segments, "emotion"]), ["segments"]),
            "final_caption_data.json": (_per_video(out["captions"], "segments", ["index"], [*segments, "text_ko"]), ["segments"]),
        }
        bodies = [store.compact(rows, columns).select("video_id", F.lit(file).alias("file"), "body") for file, (rows, columns) in documents.items()]
        store.write_documents(reduce(DataFrame.unionByName, bodies), root, indent=True)
        store.write_documents(captions.rendered(out["captions"]).select("video_id", F.lit("captions.srt").alias("file"), F.col("srt").alias("body")), root, ending="\n")
        markers = sinks.ready_markers(state.join(has(out["final"]), "video_id", "left_semi"))
        store.write_documents(markers.select("video_id", F.lit(store.READY).alias("file"), F.col("marker").alias("body")), root)
    ready = store.with_file(state.select("video_id"), root).withColumn("__ready", F.lit(True))
    skipped = media.join(done, "video_id", "left_semi").select("video_id", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    tried = state.join(ready, "video_id", "left").select("video_id", F.when(F.col("error").isNull() & F.col("__ready").isNotNull(), "ready").otherwise("failed").alias("status"), F.when(F.col("error").isNull() & F.col("__ready").isNull(), "no segments").otherwise(F.col("error")).alias("error"))
    return skipped.unionByName(tried)
