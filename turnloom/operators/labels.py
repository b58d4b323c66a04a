"""Summary, naming, reconciliation, boundary repair and correction of speaker labels."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import assignment, collapsed, stripped
from turnloom.operators._kept import kept, sized
from turnloom.operators.intervals import overlap_join


def unknown(speaker: Column) -> Column:
    return F.upper(speaker) == "UNKNOWN"


def speaker_summary(turns: DataFrame, *, top_k: int = 8) -> DataFrame:
    """OP-05 (AGG-03 to 05, WIN-10/11, SORT-03/04, PRJ-07): totals, share, rank by total with ties by first turn. UNKNOWN, in any case, is nobody and has no row; shares are of the known time."""
    dur = F.col("end_ms") - F.col("start_ms")
    known = turns.filter(~unknown(F.col("speaker")))
    s = known.groupBy("video_id", "speaker").agg(F.sum(dur).alias("total_ms"), F.count("*").alias("num_turns"), F.max(dur).alias("max_turn_ms"), F.min("pos").alias("first_pos"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("total_ms"), "first_pos"))
    whole = F.sum("total_ms").over(Window.partitionBy("video_id"))
    return s.select(
        "video_id", "speaker", "total_ms", "num_turns", "max_turn_ms", rank.cast("bigint").alias("rank"),
        F.round(F.when(whole == 0, 0.0).otherwise(F.col("total_ms") / whole), 6).alias("share"), F.round(F.col("total_ms") / F.col("num_turns"), 6).alias("avg_turn_ms"),
        (rank <= max(top_k, 0)).alias("selected_for_labeling"),
    )


def map_template(summary: DataFrame) -> DataFrame:
    """OP-05: the ids to be named, each with itself for a name."""
    return summary.filter("selected_for_labeling").select("video_id", F.col("speaker").alias("speaker_id"), F.col("speaker").alias("display_name"))


def known_totals(turns: DataFrame) -> DataFrame:
    """AGG-04: speaking time of known speakers and of UNKNOWN in any case."""
    dur = F.col("end_ms") - F.col("start_ms")
    nobody = unknown(F.col("speaker"))
    return turns.groupBy("video_id").agg(F.coalesce(F.sum(F.when(~nobody, dur)), F.lit(0)).alias("known_ms"), F.coalesce(F.sum(F.when(nobody, dur)), F.lit(0)).alias("unknown_ms"), F.countDistinct("speaker").alias("num_speakers"))


def apply_names(segments: DataFrame, names: DataFrame) -> DataFrame:
    """JOIN-06, PRJ-08: display name, the id where there is none. names(speaker_id, display_name) are counted: few are broadcast, so that segments with their words aren't dealt by the few speakers they have."""
    named = names.filter(F.trim("display_name") != "").select(F.col("speaker_id").alias("speaker"), "display_name")
    return segments.join(sized(named), "speaker", "left").withColumns({"speaker_id": F.col("speaker"), "speaker_display": F.coalesce("display_name", "speaker")}).drop("display_name")


def update_names(captions: DataFrame, names: DataFrame) -> DataFrame:
    """JOIN-07: overwrite the display name only where one is mapped."""
    new = names.select("speaker_id", F.col("display_name").alias("__new"))
    return captions.join(new, "speaker_id", "left").withColumn("speaker_display", F.coalesce("__new", "speaker_display")).drop("__new")


def saved_map(names: DataFrame) -> DataFrame:
    """SNK-10: a blank name becomes the id."""
    return names.select("speaker_id", F.coalesce(F.nullif(stripped(F.col("display_name")), F.lit("")), F.col("speaker_id")).alias("display_name"))


#: SRC-15. Where a row of names may have the name, the best first.
NAME_FIELDS = ("display_name", "speaker_display", "speaker_name", "name", "edited_name")


def read_map(documents: DataFrame, overrides: list[str] = ()) -> DataFrame:
    """SRC-15: names by speaker of documents(video_id, speakers map, rows array of structs, bare map): the speakers map if there is one, even an
    empty one, else the list of rows (of a repeated id the last) with the first name that isn't empty, else the bare map. overrides: 'id=name', over all."""
    have = set(documents.schema["rows"].dataType.elementType.fieldNames())
    filled = lambda r: F.coalesce(*[F.nullif(r[c], F.lit("")) for c in NAME_FIELDS if c in have], r["speaker_id"])
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    listed = F.transform(F.filter("rows", lambda r: r["speaker_id"].isNotNull()), lambda r: entry(r["speaker_id"], filled(r)))
    entries = lambda m: F.transform(F.map_entries(m), lambda e: entry(e["key"], e["value"]))
    picked = F.when(F.col("speakers").isNotNull(), entries(F.col("speakers"))).when(F.col("rows").isNotNull(), listed).otherwise(F.coalesce(entries(F.col("bare")), F.array()))
    over = [entry(*assignment(F.lit(x))) for x in overrides]
    rows = documents.select("video_id", F.posexplode(F.concat(picked, F.array(*over)) if over else picked).alias("at", "e"))
    return rows.groupBy("video_id", F.col("e.key").alias("speaker_id")).agg(F.max_by("e.value", "at").alias("display_name"))


def nameable(labels: DataFrame) -> DataFrame:
    """PRJ-16, SET-06: distinct labels with a prefix FACE_ or AUDIO_."""
    return labels.filter(F.col("label").startswith("FACE_") | F.col("label").startswith("AUDIO_")).select("label").distinct()


def naming_rows(table: DataFrame, labels: DataFrame) -> DataFrame:
    """OP-11 (JOIN-08/09, SET-01/02, SORT-06): the table's nameable rows and the labels it lacks, in natural order."""
    wanted = nameable(labels).withColumnRenamed("label", "speaker")
    have = table.join(wanted, "speaker", "left_semi")
    rows = have.unionByName(wanted.join(table, "speaker", "left_anti"), allowMissingColumns=True)
    return rows.withColumn("sort_kind", F.when(F.col("speaker").startswith("FACE_"), 0).otherwise(1)).withColumn("sort_no", F.coalesce(F.expr("try_cast(nullif(regexp_replace(speaker, '[^0-9]', ''), '') as bigint)"), F.lit(0)))


def latest(versions: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """SRC-04/05/06: of each key the row of the best version, with its name; `order` lists versions best first."""
    prio = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in order]), F.col("version")), F.lit(0)), F.lit(len(order) + 1))
    return versions.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(prio, "version"))).filter("rn = 1").drop("rn")


#: SRC-04, 05, 06: versions of the turns and of the segments, the best first. gap_corrected comes before corrected, though it is made earlier.
TURN_VERSIONS = ["reconciled", "raw"]
SEGMENT_VERSIONS = ["final", "gap_corrected", "corrected", "raw"]
CAPTION_VERSIONS = ["emotion", *SEGMENT_VERSIONS]


def face_overlaps(turns: DataFrame, faces: DataFrame) -> DataFrame:
    """JOIN-05, SORT-02: overlap of a turn with each face's speaking intervals, with rank and lead over the next."""
    pair = overlap_join(turns.select("video_id", "pos", "speaker", "start_ms", "end_ms"), faces, ("face_id",))
    g = pair.groupBy("video_id", "pos", "speaker", F.expr("end_ms - start_ms").alias("dur"), "face_id").agg(F.sum("overlap_ms").alias("overlap_ms"), F.min("t0").alias("first_seen"))
    w = Window.partitionBy("video_id", "pos").orderBy(F.desc("overlap_ms"), "first_seen", "face_id")
    return g.select("*", F.row_number().over(w).alias("rn"), F.coalesce(F.lead("overlap_ms").over(w), F.lit(0)).alias("second"))


def with_faces(turns: DataFrame, faces: DataFrame) -> DataFrame:
    """turns with faces, an array of struct(o, first_seen, face_id, overlap_ms), the most overlapping first."""
    g = face_overlaps(turns, faces)
    each = g.groupBy("video_id", "pos").agg(F.sort_array(F.collect_list(F.struct((-F.col("overlap_ms")).alias("o"), "first_seen", "face_id", "overlap_ms"))).alias("faces"))
    return turns.join(each, ["video_id", "pos"], "left")


def reconcile(turns: DataFrame, faces: DataFrame) -> DataFrame:
    """OP-02: phase A takes a turn's confident face (coverage 0.2, margin 0.15, 0.12 s); phase B gives what is left
    the confident face of its audio label (coverage 0.65, margin 0.25, 2 s) if A found that label no other. Thresholds are compared as integers.

    Turns meet faces once; each turn then has its faces in its row, and what labels need is summed from there."""
    top, second = F.get("faces", F.lit(0)), F.coalesce(F.get("faces", F.lit(1))["overlap_ms"], F.lit(0))
    dur = F.col("end_ms") - F.col("start_ms")
    sure = F.coalesce((100 * top["overlap_ms"] >= 20 * dur) & (100 * (top["overlap_ms"] - second) >= 15 * dur) & (top["overlap_ms"] >= 120), F.lit(False))
    t = kept(with_faces(turns.select("video_id", "pos", "speaker", "start_ms", "end_ms"), faces).select(
        "video_id", "pos", "speaker", "start_ms", "end_ms", "faces", F.when(sure, top["face_id"]).alias("face_id"), F.when(sure, F.round(top["overlap_ms"] / dur, 3)).alias("cov"), F.when(sure, F.round((top["overlap_ms"] - second) / dur, 3)).alias("margin"),
    ))
    of_label = t.groupBy("video_id", "speaker").agg(F.sum(dur).alias("total"), F.collect_set("face_id").alias("found"))
    seen = t.select("video_id", "speaker", "pos", F.posexplode("faces").alias("rn", "f")).groupBy("video_id", "speaker", F.col("f.face_id").alias("face_id")).agg(F.sum("f.overlap_ms").alias("o"), F.min(F.struct("pos", "rn")).alias("first"))
    best = seen.groupBy("video_id", "speaker").agg(F.sort_array(F.collect_list(F.struct((-F.col("o")).alias("less"), "first", "face_id", "o"))).alias("b"))
    o, o2 = F.get("b", F.lit(0))["o"], F.coalesce(F.get("b", F.lit(1))["o"], F.lit(0))
    face_of_label = F.get("b", F.lit(0))["face_id"]
    alone = (F.size("found") == 0) | ((F.size("found") == 1) & (F.get("found", F.lit(0)) == face_of_label))
    back = of_label.join(best, ["video_id", "speaker"]).filter((100 * o >= 65 * F.col("total")) & (100 * (o - o2) >= 25 * F.col("total")) & (F.col("total") >= 2000) & alone).select("video_id", "speaker", face_of_label.alias("back_face"))
    face = F.coalesce("face_id", "back_face")
    return t.join(back, ["video_id", "speaker"], "left").select(
        "video_id", "pos", F.col("speaker").alias("speaker_audio"), F.coalesce(F.concat(F.lit("FACE_"), face), F.col("speaker")).alias("speaker"),
        F.when(F.col("face_id").isNotNull(), "visual").when(F.col("back_face").isNotNull(), "visual_global").otherwise("audio").alias("reconcile_source"), "cov", "margin", "start_ms", "end_ms",
    )


def face_hints(turns: DataFrame, faces: DataFrame, reconciled: DataFrame) -> DataFrame:
    """JOIN-11: for each audio label the face that it overlaps most, unless the label was given a face as a whole."""
    by_face = face_overlaps(turns, faces).groupBy("video_id", "speaker", "face_id").agg(F.sum("overlap_ms").alias("o"), F.min(F.struct("pos", "rn")).alias("first"))
    best = by_face.groupBy("video_id", F.col("speaker").alias("speaker_audio")).agg(F.min(F.struct((-F.col("o")).alias("o"), "first", "face_id")).alias("best"))
    resolved = reconciled.filter("reconcile_source = 'visual_global'").select("video_id", "speaker_audio").distinct()
    return best.join(resolved, ["video_id", "speaker_audio"], "left_anti").select("video_id", "speaker_audio", F.col("best.face_id").alias("face_id"))


def track_faces(frames: DataFrame, faces: DataFrame) -> DataFrame:
    """JOIN-16, AGG-17: of each face its tracks and their frames; frames: video_id, track, frame (null for a track without any); faces: video_id, track, face_id of the tracks that have one."""
    return frames.join(faces, ["video_id", "track"]).groupBy("video_id", "face_id").agg(F.count_distinct("track").alias("tracks"), F.count("frame").alias("frames"))


def shown_crops(speakers: DataFrame, crops: DataFrame, hints: DataFrame) -> DataFrame:
    """JOIN-10: the face crop of each speaker (video_id, speaker): its own FACE_n, else that of its hint; only crops(video_id, crop) that exist."""
    hinted = speakers.join(hints.select("video_id", F.col("speaker_audio").alias("speaker"), "face_id"), ["video_id", "speaker"], "left")
    crop = F.when(F.col("speaker").startswith("FACE_"), F.col("speaker")).otherwise(F.concat(F.lit("FACE_"), F.col("face_id")))
    return hinted.select("video_id", "speaker", crop.alias("crop"), (~F.col("speaker").startswith("FACE_")).alias("hint")).join(crops, ["video_id", "crop"], "left_semi")


def reconcile_audit(reconciled: DataFrame) -> DataFrame:
    """AGG-07 to AGG-09: faces with several labels, labels with several faces, coverage of either source."""
    seen = reconciled.filter("reconcile_source <> 'audio'")
    dur = F.col("end_ms") - F.col("start_ms")
    merges = seen.groupBy("video_id", "speaker").agg(F.countDistinct("speaker_audio").alias("n")).groupBy("video_id").agg(F.count_if(F.col("n") >= 2).alias("n_merges_fixed"))
    splits = seen.groupBy("video_id", "speaker_audio").agg(F.countDistinct("speaker").alias("n")).groupBy("video_id").agg(F.count_if(F.col("n") >= 2).alias("n_splits_fixed"))
    share = lambda kind: F.round(F.sum(F.when(F.col("reconcile_source") == kind, dur).otherwise(0)) / F.sum(dur), 3)
    cover = reconciled.groupBy("video_id").agg(share("visual").alias("onscreen_coverage"), share("visual_global").alias("global_backfill_coverage"))
    return cover.join(merges, "video_id", "left").join(splits, "video_id", "left").fillna(0, ["n_merges_fixed", "n_splits_fixed"])


def boundary_candidates(spans: DataFrame, *, pause_ms: int = 300) -> DataFrame:
    """WIN-06, SET-05: glued spans with exactly one label change, and a pause or an edge on both sides."""
    w = Window.partitionBy("video_id").orderBy("pos")
    t = spans.withColumns({"change": ((F.lag("speaker").over(w) != F.col("speaker")) & (F.lag("span").over(w) == F.col("span"))).cast("int"), "before": F.col("gap_ms"), "after": F.lead("gap_ms").over(w)})
    g = t.groupBy("video_id", "span").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.coalesce(F.sum("change"), F.lit(0)).alias("changes"), F.min_by("before", "pos").alias("before_ms"), F.max_by("after", "pos").alias("after_ms"),
        F.min_by("speaker", "pos").alias("left_label"), F.max_by("speaker", "pos").alias("right_label"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: collapsed(x["text"])), " ").alias("text"),
    )
    return g.filter((F.col("changes") == 1) & (F.coalesce("before_ms", F.lit(pause_ms)) >= pause_ms) & (F.coalesce("after_ms", F.lit(pause_ms)) >= pause_ms))


def anchor_target(candidates: DataFrame, turns: DataFrame) -> DataFrame:
    """JOIN-21, SET-04: the one internal label that an adjacent turn supports, else null."""
    w = Window.partitionBy("video_id").orderBy("pos")
    near = turns.select("video_id", "pos", F.lag("speaker").over(w).alias("left_anchor"), F.lead("speaker").over(w).alias("right_anchor"))
    left = near.select("video_id", F.col("pos").alias("lo"), "left_anchor")
    right = near.select("video_id", F.col("pos").alias("hi"), "right_anchor")
    c = candidates.join(left, ["video_id", "lo"]).join(right, ["video_id", "hi"])
    hits = F.array_intersect(F.array("left_label", "right_label"), F.array_compact(F.array("left_anchor", "right_anchor")))
    return c.withColumn("target_speaker", F.when(F.size(hits) == 1, F.get(hits, F.lit(0))))


def repair_boundaries(turns: DataFrame, judged: DataFrame) -> DataFrame:
    """OP-03: turns of approved spans (judged: video_id, lo, hi, target_speaker, approved) take the target's label; their old one is kept.
    Turns of every candidate span are marked as checked."""
    approved = F.coalesce(F.col("approved"), F.lit(False)) & F.col("target_speaker").isNotNull()
    span = judged.select("video_id", F.explode(F.sequence("lo", "hi")).alias("pos"), F.when(approved, F.col("target_speaker")).alias("__to"), F.lit(True).alias("__in"))
    t = turns.join(span, ["video_id", "pos"], "left")
    moved = F.col("__to").isNotNull() & (F.col("__to") != F.col("speaker"))
    return t.withColumns({"speaker_original": F.when(moved, F.col("speaker")), "speaker": F.coalesce("__to", "speaker"), "checked": F.col("__in").isNotNull()}).drop("__to", "__in")


def run_candidates(runs: DataFrame, *, max_ms: int = 3000) -> DataFrame:
    """WIN-09 with JOIN-13: centres of three runs that are short, have text, and differ from a neighbour. Of only two runs the one with
    fewer segments, if it is short; else the first, if it is short and shorter; else so the second."""
    w = Window.partitionBy("video_id").orderBy("run_index")
    beside = {f"{side}_{c}": f(c).over(w) for side, f in (("left", F.lag), ("right", F.lead)) for c in ("speaker", "speech_ms", "num_segments")}
    r = runs.withColumns({**beside, "n": F.count("*").over(Window.partitionBy("video_id"))})
    short = F.col("speech_ms") <= max_ms
    differs = F.coalesce(F.col("left_speaker") != F.col("speaker"), F.lit(False)) | F.coalesce(F.col("right_speaker") != F.col("speaker"), F.lit(False))
    inner = F.col("left_speaker").isNotNull() & F.col("right_speaker").isNotNull()
    other = lambda c: F.coalesce(f"left_{c}", f"right_{c}")
    fewer, more = F.col("num_segments") < other("num_segments"), F.col("num_segments") > other("num_segments")
    other_picked = more & (other("speech_ms") <= max_ms)  # the other one, as it has fewer segments
    shorter = short & (F.col("speech_ms") < other("speech_ms"))
    # between two runs at most one is shorter, so the order of asking doesn't matter
    of_two = differs & F.when(fewer & short, F.lit(True)).when(other_picked, F.lit(False)).otherwise(shorter)
    of_many = (F.col("text") != "") & short & differs & inner
    return r.filter(F.when(F.col("n") == 2, of_two).otherwise(of_many)).drop("left_speech_ms", "right_speech_ms", "left_num_segments", "right_num_segments")


def eligibility(runs: DataFrame, *, max_gap_ms: int = 1500, max_overlap_ms: int = 50) -> DataFrame:
    """PRJ-20: each border of two runs and the first reason against it."""
    w = Window.partitionBy("video_id").orderBy("run_index")
    r = runs.withColumns({"next_speaker": F.lead("speaker").over(w), "next_text": F.lead("text").over(w), "gap_ms": F.lead("start_ms").over(w) - F.col("end_ms")}).filter("next_speaker is not null")
    reason = F.when(F.col("speaker") == F.col("next_speaker"), "same_label").when(F.col("gap_ms") > max_gap_ms, "gap_too_large").when(F.col("gap_ms") < -max_overlap_ms, "overlap").when((F.col("text") == "") | (F.col("next_text") == ""), "empty_text")
    return r.select("video_id", "run_index", "gap_ms", reason.alias("reason"), reason.isNull().alias("eligible"))


def resolved(left_speaker: Column, right_speaker: Column, left_same: Column, right_same: Column, run_index: Column) -> tuple[Column, Column, Column]:
    """PRJ-21: (resolution, target, anchor runs) of a run from its two judged borders."""
    agree = left_speaker == right_speaker
    how = F.when(left_same & right_same, F.when(agree, "both_agree").otherwise("both_conflict")).when(left_same, "left").when(right_same, "right").otherwise("none")
    target = F.when(how.isin("both_agree", "left"), left_speaker).when(how == "right", right_speaker)
    anchors = F.when(how == "both_agree", F.array(run_index - 1, run_index + 1)).when(how == "left", F.array(run_index - 1)).when(how == "right", F.array(run_index + 1))
    return how, target, anchors


def with_borders(candidates: DataFrame, borders: DataFrame) -> DataFrame:
    """Candidates with left_same and right_same (borders: video_id, run_index of the left run, same)."""
    left = borders.select("video_id", (F.col("run_index") + 1).alias("run_index"), F.col("same").alias("left_same"))
    right = borders.select("video_id", "run_index", F.col("same").alias("right_same"))
    return candidates.join(left, ["video_id", "run_index"], "left").join(right, ["video_id", "run_index"], "left").fillna(False, ["left_same", "right_same"])


def proposals(candidates: DataFrame, borders: DataFrame) -> DataFrame:
    """PRJ-21: new labels for runs, from their judged borders."""
    c = with_borders(candidates, borders)
    how, target, anchors = resolved(*(F.col(x) for x in ("left_speaker", "right_speaker", "left_same", "right_same", "run_index")))
    return c.select("video_id", "run_index", F.col("speaker").alias("from_speaker"), how.alias("resolution"), target.alias("to_speaker"), anchors.alias("anchors")).filter("to_speaker is not null and to_speaker <> from_speaker")


def conflicts(approved: DataFrame) -> DataFrame:
    """JOIN-14, JOIN-18, SET-08: proposals whose anchor run is itself approved to another target; both are conflicted."""
    a = approved.select("video_id", "run_index", "to_speaker", F.explode("anchors").alias("anchor"))
    q = approved.select("video_id", F.col("run_index").alias("anchor"), F.col("to_speaker").alias("q_to"))
    hit = a.join(q, ["video_id", "anchor"]).filter("to_speaker <> q_to")
    return hit.select("video_id", "run_index").union(hit.select("video_id", "anchor")).distinct()


def correct_runs(runs: DataFrame, approved: DataFrame) -> DataFrame:
    """OP-04's end: runs take the target of their approved proposal, unless it is in conflict with another."""
    clear = approved.join(conflicts(approved), ["video_id", "run_index"], "left_anti").select("video_id", "run_index", "to_speaker")
    out = runs.join(clear, ["video_id", "run_index"], "left")
    return out.withColumn("speaker_original", F.when(F.col("to_speaker").isNotNull(), F.col("speaker"))).withColumn("speaker", F.coalesce("to_speaker", "speaker")).drop("to_speaker")
