"""Word evidence of segments and runs, and the repair chains OP-03 and OP-04 over segments with their words.

segments: video_id, index, speaker, start_ms, end_ms, text, words (see intervals.WORD_FIELDS). The chains keep what several steps read as tables.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import MOVE_ENDS, collapsed, ends_sentence, joined_lines
from turnloom.operators import asking, labels
from turnloom.operators import intervals as I
from turnloom.operators._kept import kept

#: Fixed values of the fragment rule and of what a word has to have.
FRAGMENT_MS, FRAGMENT_WORDS, WEAK_COVERAGE, STABLE_COVERAGE, VISUAL_SHARE = 500, 2, 0.5, 0.75, 0.5
#: Fixed values of the word moves: a sentence opener's words and time, how near the next segment is, and the share of it that a face speaks for.
MOVE_WORDS, MOVE_MS, MOVE_GAP_MS, MOVE_SHARE = 2, 650, 100, 0.75
#: Fixed first line of what a judge or a verifier is shown.
CONTEXT_TITLE = "Transcript context (speaker IDs omitted):"


def _own(words: Column, speaker: Column) -> Column:
    return F.filter(words, lambda w: F.coalesce(w["speaker"], speaker) == speaker)


def _ms(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.greatest(w["end_ms"] - w["start_ms"], F.lit(0)))


def word_support(segments: DataFrame) -> DataFrame:
    """AGG-13, AGG-14: of a segment's words that carry its own label: their time, that of those which a face speaks for (and whose label
    is the original one), and whether any is stable: not ambiguous and covered well."""
    own = _own(F.col("words"), F.col("speaker"))
    seen = F.filter(own, lambda w: (F.coalesce(w["speaker_original"], F.col("speaker")) == F.col("speaker")) & F.coalesce(w["reconcile_source"] == "visual", F.lit(False)))
    stable = F.exists(own, lambda w: ~F.coalesce(w["boundary_ambiguous"], F.lit(False)) & (F.coalesce(w["coverage"], F.lit(0.0)) >= STABLE_COVERAGE))
    return segments.withColumns({"own_ms": _ms(own), "visual_ms": _ms(seen), "stable": stable})


def visual_share() -> Column:
    """AGG-13: of word_support()'s columns."""
    return F.when(F.col("own_ms") > 0, F.col("visual_ms") / F.col("own_ms")).otherwise(0.0)


_TAIL = "array<struct<ms:bigint,ends:boolean,own:boolean>>"


def handed_on(steps: Column) -> Column:
    """WIN-18: how many of its last words each of consecutive segments hands to the next one, in order.

    steps: array of n (the segment's words), tail (ms, ends and own of its last three at most: time, whether a sentence ends, whether it carries the
    segment's label) and goes (whether words may go to the next segment). What a segment was handed stands before its own words.
    """

    def step(done, s):
        line = F.when(s["n"] <= MOVE_WORDS, F.concat(done["got"], s["tail"])).otherwise(s["tail"])
        last = lambda k: F.slice(line, F.size(line) - k + 1, k)
        ms = lambda k: F.aggregate(last(k), F.lit(0).cast("bigint"), lambda a, w: a + w["ms"])
        opens = lambda k: (F.size(line) > k) & F.coalesce(F.get(line, F.size(line) - k - 1)["ends"], F.lit(False)) & (ms(F.lit(k)) <= MOVE_MS)
        many = F.when(~s["goes"], 0)
        for k in range(1, MOVE_WORDS + 1):
            many = many.when(opens(k), F.when(F.forall(last(F.lit(k)), lambda w: w["own"]), k).otherwise(0))
        many = many.otherwise(0)
        return F.struct(F.transform(last(many), lambda w: w.withField("own", F.lit(True))).cast(_TAIL).alias("got"), F.concat(done["many"], F.array(many)).alias("many"))

    return F.aggregate(steps, F.struct(F.array().cast(_TAIL).alias("got"), F.array().cast("array<int>").alias("many")), step, lambda done: done["many"])


def moved_openers(segments: DataFrame) -> DataFrame:
    """WIN-17, WIN-18, PRJ-17: one or two short words after a sentence end go to the next segment, if a face there is sure; both segments are built anew from their words.

    What a segment hands on can depend on what it was handed, and so on backwards, but only if it has two words at most and may hand on at all; such stretches
    are folded in order, all in the JVM. Words keep their order, so a segment's words are then the last ones before it, as many as it was handed, and
    its own but those it hands on; they stand in the two segments before it. Columns received and handed_on count them.
    """
    columns = segments.columns
    order = Window.partitionBy("video_id").orderBy("index")
    after = lambda c: F.lead(c).over(order)
    label = lambda w: F.coalesce(w["speaker"], F.col("speaker"))
    words = F.transform("words", lambda w: w.withField("correction_source", F.lit(None).cast("string")))
    t = word_support(segments).withColumns({"words": words, "n": F.size("words")})
    tail = F.transform(
        F.slice("words", F.greatest(F.col("n") - MOVE_WORDS, F.lit(1)), MOVE_WORDS + 1),
        lambda w: F.struct(F.greatest(w["end_ms"] - w["start_ms"], F.lit(0)).cast("bigint").alias("ms"), ends_sentence(w["word"], MOVE_ENDS, ()).alias("ends"), (label(w) == F.col("speaker")).alias("own")),
    )
    sure = (F.col("own_ms") > 0) & (F.col("visual_ms") >= MOVE_SHARE * F.col("own_ms"))
    goes = (F.col("speaker") != after("speaker")) & after("speaker").startswith("FACE_") & (F.abs(after("start_ms") - F.col("end_ms")) <= MOVE_GAP_MS) & after(sure) & (after("n") > 0)
    t = t.withColumns({"goes": F.coalesce(goes, F.lit(False)), "tail": F.when(F.col("n") > 0, tail).otherwise(F.array().cast(_TAIL)), "sure": sure})
    t = I.islands(t, ["index"], (F.col("n") > MOVE_WORDS) | ~F.lag("goes").over(order), "stretch")
    # a stretch is folded with its segments in one row, so that they need no join, and stay where the windows over their video have them
    whole = [c for c in t.columns if c not in ("video_id", "stretch")]
    rows = F.sort_array(F.collect_list(F.struct("index", F.struct(*whole).alias("row"))))
    folded = t.groupBy("video_id", "stretch").agg(F.transform(rows, lambda x: x["row"]).alias("rows"))
    steps = F.transform("rows", lambda x: F.struct(x["index"].alias("index"), x["n"].alias("n"), x["tail"].alias("tail"), x["goes"].alias("goes")))
    many = F.when(F.exists("rows", lambda x: x["goes"]), handed_on(steps)).otherwise(F.transform("rows", lambda x: F.lit(0)))
    t = folded.select("video_id", F.explode(F.arrays_zip(F.col("rows").alias("row"), many.alias("handed_on"))).alias("s")).select("video_id", "s.row.*", "s.handed_on").drop("tail", "goes", "sure")
    own_last = F.transform(F.slice("words", F.greatest(F.col("n") - MOVE_WORDS + 1, F.lit(1)), MOVE_WORDS), lambda w: w.withField("speaker", label(w)))
    none = F.array().cast(t.schema["words"].dataType)
    t = t.withColumn("last", F.when(F.col("n") > 0, own_last).otherwise(none))
    t = t.withColumns({"before": F.concat(F.coalesce(F.lag("last", 2).over(order), none), F.coalesce(F.lag("last").over(order), none)), "received": F.coalesce(F.lag("handed_on").over(order), F.lit(0))})
    came = F.transform(
        F.slice("before", F.size("before") - F.col("received") + 1, F.col("received") - F.greatest(F.col("handed_on") - F.col("n"), F.lit(0))),
        lambda w: w.withField("speaker_original", F.coalesce(w["speaker_original"], w["speaker"])).withField("speaker", F.col("speaker")).withField("correction_source", F.lit("semantic_boundary_word")),
    )
    changed = (F.col("received") > 0) | (F.col("handed_on") > 0)
    t = t.withColumn("words", F.when(changed, F.concat(came, F.slice("words", F.lit(1), F.greatest(F.col("n") - F.col("handed_on"), F.lit(0))))).otherwise(F.col("words")))
    t = t.withColumns({c: F.when(changed, x).otherwise(F.col(c)) for c, x in I.from_words(F.col("words")).items() if c in columns})
    return t.select(*columns, "received", "handed_on")


def weak_fragment(segment: Column, speaker: Column, target: Column) -> Column:
    """AGG-15: one or two words, at most half a second, all of the run's own label, ambiguous, hardly covered, and with the target among their candidates (JOIN-18). A word without coverage is not weak."""
    weak = lambda w: (
        (F.coalesce(w["speaker"], speaker) == speaker) & F.coalesce(w["boundary_ambiguous"], F.lit(False)) & (F.coalesce(w["coverage"], F.lit(1.0)) <= WEAK_COVERAGE) & F.coalesce(F.exists(w["candidates"], lambda c: c["speaker"] == target), F.lit(False))
    )
    return F.coalesce(F.size(segment["words"]).between(1, FRAGMENT_WORDS) & (segment["end_ms"] - segment["start_ms"] <= FRAGMENT_MS) & F.forall(segment["words"], weak), F.lit(False))


def relabelled(words: Column, old: Column, new: Column, *, keep_original: bool) -> Column:
    """Words of the old label get the new one; keep_original: and remember the old one."""
    return F.transform(
        words,
        lambda w: F.when(
            F.coalesce(w["speaker"], old) == old, w.withField("speaker", new).withField("speaker_original", F.coalesce(w["speaker_original"], old) if keep_original else w["speaker_original"])
        ).otherwise(w),
    )


def remerged(segments: DataFrame, *, glue_ms: int = 100) -> DataFrame:
    """WIN-05, AGG-16 for segments with words: of a merged row coverage, ambiguity and source are the first part's, ids are put together as they are, numbers are anew from 0."""
    gap = F.col("start_ms") - I.previous("end_ms", ["index"])
    t = I.islands(segments, ["index"], (I.previous("speaker", ["index"]) != F.col("speaker")) | ~gap.between(-50, glue_ms), "__to")
    parts = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("index", F.col(c).alias("x")))), lambda p: p["x"])
    first = ("coverage", "boundary_ambiguous", "source", "speaker_original", "correction_source")
    return t.groupBy("video_id", F.col("__to").alias("index")).agg(
        F.min("speaker").alias("speaker"), F.min_by("start_ms", "index").alias("start_ms"), F.max_by("end_ms", "index").alias("end_ms"),
        F.when(F.count("*") == 1, F.first("text")).otherwise(joined_lines(parts("text"))).alias("text"), F.sum("overlap_ms").alias("overlap_ms"), F.flatten(parts("words")).alias("words"),
        F.flatten(parts("asr_segment_ids")).alias("asr_segment_ids"), F.array_sort(F.array_distinct(F.flatten(parts("match_methods")))).alias("match_methods"), F.bool_or("checked").alias("checked"),
        F.array_sort(F.collect_set("correction_source")).alias("correction_sources"), *[F.min_by(c, "index").alias(c) for c in first],
    ).withColumns({"num_words": F.size("words").cast("bigint"), "duration_ms": F.col("end_ms") - F.col("start_ms")})


def span_texts(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidate spans with what the judge is shown: the text before the change of label, and the window around the span with pauses (PRJ-25)."""
    inside = spans.select("video_id", "span", "lo", "hi", "left_label", F.explode(F.sequence(F.col("lo") - 3, F.col("hi") + 3)).alias("pos"))
    order = Window.partitionBy("video_id").orderBy("pos")
    lines = rows.select("video_id", "pos", "speaker", collapsed(F.col("text")).alias("line"), (F.col("start_ms") - F.lag("end_ms").over(order)).alias("pause_ms"))
    j = inside.join(lines, ["video_id", "pos"])
    within = F.col("pos").between(F.col("lo"), F.col("hi"))
    cs = F.rint(F.abs("pause_ms") / 10).cast("bigint")
    pause = F.concat(F.lit("["), F.when((F.col("pause_ms") < 0) & (cs > 0), "-").otherwise(""), F.floor(cs / 100), F.lit("."), F.lpad((cs % 100).cast("string"), 2, "0"), F.lit("s] "))
    role = F.when(F.col("pos") == F.col("lo") - 1, "(BEFORE) ").when(F.col("pos") == F.col("hi") + 1, "(AFTER) ").otherwise("")
    g = j.groupBy("video_id", "span").agg(
        F.sort_array(F.collect_list(F.struct("pos", within.alias("within"), pause.alias("pause"), role.alias("role"), "line"))).alias("l"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(within & (F.col("speaker") == F.col("left_label")), F.struct("pos", "line")))), lambda x: x["line"]), " ").alias("left_text"),
    )
    said = F.array_join(F.transform(F.filter("l", lambda x: x["within"]), lambda x: x["line"]), " ")
    shown = F.filter("l", lambda x, i: ~x["within"] | (i == 0) | ~F.coalesce(F.get("l", i - 1)["within"], F.lit(False)))
    line = lambda x, i: F.concat(F.lit("  "), F.when(i > 0, F.coalesce(x["pause"], F.lit(""))).otherwise(""), F.when(x["within"], F.concat(F.lit('U >> "'), said, F.lit('"'))).otherwise(F.concat(x["role"], F.lit('"'), x["line"], F.lit('"'))))
    title = F.lit("Dialogue excerpt (speaker labels hidden; [..s] = pause before the line):\n")
    return spans.join(g.select("video_id", "span", "left_text", F.concat(title, F.array_join(F.transform(shown, line), "\n")).alias("window")), ["video_id", "span"])


def repair_segments(segments: DataFrame, judge: asking.Step = asking.rule_span_judge, *, glue_ms: int = 100, pause_ms: int = 300) -> tuple[DataFrame, DataFrame]:
    """OP-03: (segments, decisions): glued spans with one change of label between pauses take the label that a neighbour has, if the judge says that they are one utterance; then glued parts of a speaker become one."""
    rows = kept(segments.withColumn("pos", F.col("index")))
    spans = labels.anchor_target(labels.boundary_candidates(I.glued_spans(rows, glue_ms=glue_ms), pause_ms=pause_ms), rows)
    shown = span_texts(spans.filter("target_speaker is not null"), rows)
    verdict = judge(shown).select("video_id", "span", "approved")
    decisions = kept(spans.join(verdict, ["video_id", "span"], "left"))
    how = F.when(F.col("target_speaker").isNull(), "ambiguous_anchor").when(F.col("approved"), "boundary_continuation").otherwise("plausible_speaker_change")
    out = labels.repair_boundaries(rows, decisions)
    moved = F.col("speaker_original").isNotNull()
    # the words' own former labels aren't kept, so what spoke for them speaks for the new label
    out = out.withColumns({"words": F.when(moved, relabelled(F.col("words"), F.col("speaker_original"), F.col("speaker"), keep_original=False)).otherwise(F.col("words")), "correction_source": F.when(moved, "boundary_continuation")})
    return remerged(out, glue_ms=glue_ms), decisions.select("video_id", "lo", "hi", "text", "left_label", "right_label", F.col("approved").alias("same_utterance"), F.when(F.col("approved"), F.col("target_speaker")).alias("target_speaker"), how.alias("resolution"))


def context_windows(runs: DataFrame, *, count: int = 3) -> DataFrame:
    """WIN-08: of each run a window of `count` runs around it, as wide as it can be at the edges too: near, an array of run_index, start_ms, end_ms, text."""
    order = Window.partitionBy("video_id").orderBy("run_index")
    near = F.collect_list(F.struct("run_index", "start_ms", "end_ms", "text")).over(order.rowsBetween(-count + 1, count - 1))
    t = runs.select("video_id", "run_index", near.alias("near"), F.count("*").over(Window.partitionBy("video_id")).alias("n"))
    t = t.withColumn("c", F.least(F.lit(count), "n")).withColumn("s", F.expr("greatest(0, least(run_index - c div 2, n - c))"))
    return t.select("video_id", "run_index", F.expr("filter(near, x -> x.run_index >= s and x.run_index < s + c)").alias("near"))


def context_text(near: Column, target: Column | None = None, anchors: Column | None = None) -> Column:
    """PRJ-25: the lines of a window. target: the run in question, with times and text of its own (a fragment's, if only that is in question); anchors: indices of the runs that speak for it."""
    hundredths = lambda ms: F.rint(F.abs(ms) / 10).cast("bigint")
    seconds = lambda ms: F.concat(F.when(ms < 0, "-").otherwise(""), F.floor(hundredths(ms) / 100).cast("string"), F.lit("."), F.lpad((hundredths(ms) % 100).cast("string"), 2, "0"))

    def line(x):
        mark = F.lit("")
        if target is not None:
            own = x["run_index"] == target["run_index"]
            names = F.array_join(F.array_compact(F.array(F.when(own, "TARGET"), F.when(F.array_contains(anchors, x["run_index"]), "ANCHOR"))), " ")
            mark = F.when(names != "", F.concat(F.lit(" ["), names, F.lit("]"))).otherwise("")
            x = {c: F.when(own, target[c]).otherwise(x[c]) for c in ("start_ms", "end_ms", "text")} | {"run_index": x["run_index"]}
        return F.concat(F.lit("RUN_"), x["run_index"], mark, F.lit(" ["), seconds(x["start_ms"]), F.lit("-"), seconds(x["end_ms"]), F.lit("]: "), x["text"])

    return F.concat(F.lit(CONTEXT_TITLE + "\n"), F.array_join(F.transform(near, line), "\n"))


class Correction(NamedTuple):
    """What OP-04 gives: segments; proposals with their status; a record of each candidate; a record of each border looked at, with the reason where it wasn't asked."""

    segments: DataFrame
    proposals: DataFrame
    candidates: DataFrame
    borders: DataFrame


def correct_segments(
    segments: DataFrame, judge: asking.Step = asking.rule_judge, verify: asking.Step = asking.rule_verifier, *,
    max_ms: int = 3000, merge_gap_ms: int = 1500, max_gap_ms: int = 1500, max_overlap_ms: int = 50, context_runs: int = 3, verify_adjustments: bool = True,
) -> Correction:
    """OP-04. Words that open a sentence move to the face that says it. Then short runs between others are relabelled if the judge says that an utterance goes on over
    their borders and the verifier agrees; a weak fragment at the neighbour's edge moves instead if the run has a stable word; a run that faces speak for stays.

    The judge sees each border that can be one (PRJ-20) and is beside a candidate, once: left_text, right_text, gap_ms, and as context the window around the candidate that
    asks first. The verifier sees target_text, the anchors' texts and the window with target and anchors marked, a fragment in its run's place. Proposals in conflict aren't applied.
    """
    segments = kept(moved_openers(segments))
    s = word_support(segments.withColumn("pos", F.col("index")))
    checked = F.coalesce(F.col("checked"), F.lit(False)) if "checked" in segments.columns else F.lit(False)
    # only a fragment's few words are looked at, so others' stay behind
    few = F.when(F.size("words") <= FRAGMENT_WORDS, F.col("words")).otherwise(F.array().cast(segments.schema["words"].dataType))
    edge = F.struct("pos", "start_ms", "end_ms", few.alias("words"), collapsed(F.col("text")).alias("text"))
    s = s.select("video_id", "pos", "speaker", "start_ms", "end_ms", "text", checked.alias("checked"), "stable", "own_ms", "visual_ms", edge.alias("edge"))
    runs = kept(I.rolled_up(
        I.run_members(s, merge_gap_ms=merge_gap_ms), F.bool_or("checked").alias("checked"), F.bool_or("stable").alias("stable"),
        ((F.sum("own_ms") > 0) & (F.sum("visual_ms") >= VISUAL_SHARE * F.sum("own_ms"))).alias("direct_visual"), F.min_by("edge", "pos").alias("head"), F.max_by("edge", "pos").alias("tail"),
    ))
    order = Window.partitionBy("video_id").orderBy("run_index")
    windows = context_windows(runs, count=context_runs)
    beside = runs.withColumns({"left_tail": F.lag("tail").over(order), "right_head": F.lead("head").over(order), "left_text": F.lag("text").over(order), "right_text": F.lead("text").over(order)})
    candidates = labels.run_candidates(beside, max_ms=max_ms).filter("not checked").join(windows, ["video_id", "run_index"])

    asks = candidates.select("video_id", F.col("run_index").alias("candidate_run"), context_text(F.col("near")).alias("context"), F.explode(F.array(F.col("run_index") - 1, "run_index")).alias("run_index"))
    asks = asks.groupBy("video_id", "run_index").agg(F.min(F.struct("candidate_run", "context")).alias("a")).select("video_id", "run_index", "a.*")
    texts = runs.select("video_id", "run_index", F.col("text").alias("left_text"), F.lead("text").over(order).alias("right_text"))
    looked_at = labels.eligibility(runs, max_gap_ms=max_gap_ms, max_overlap_ms=max_overlap_ms).join(asks, ["video_id", "run_index"]).join(texts, ["video_id", "run_index"])
    judged = judge(looked_at.filter("eligible")).select("video_id", "run_index", "same")
    borders = kept(looked_at.drop("left_text", "right_text", "eligible").withColumnRenamed("reason", "skipped_reason").join(judged, ["video_id", "run_index"], "left").fillna(False, ["same"]))
    c = kept(labels.with_borders(candidates, borders))

    how, target, anchors = labels.resolved(*(F.col(x) for x in ("left_speaker", "right_speaker", "left_same", "right_same", "run_index")))
    from_left = F.col("stable") & F.col("left_same") & ~F.col("right_same") & weak_fragment(F.col("left_tail"), F.col("left_speaker"), F.col("speaker"))
    from_right = F.col("stable") & F.col("right_same") & ~F.col("left_same") & weak_fragment(F.col("right_head"), F.col("right_speaker"), F.col("speaker"))
    shown = lambda run, x: F.struct(run.alias("run_index"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["text"].alias("text"))
    fragment = lambda run, seg, old, name: F.struct(
        F.lit("move_boundary_fragment").alias("action"), run.alias("run_index"), seg["pos"].alias("lo"), seg["pos"].alias("hi"), old.alias("from_speaker"), F.col("speaker").alias("to_speaker"),
        F.array("run_index").alias("anchors"), F.lit(name).alias("resolution"), seg["text"].alias("target_text"), F.array("text").alias("anchor_texts"), context_text(F.col("near"), shown(run, seg), F.array("run_index")).alias("context"),
    )
    beside_texts = F.when(how == "both_agree", F.array("left_text", "right_text")).when(how == "left", F.array("left_text")).otherwise(F.array("right_text"))
    own = F.struct("start_ms", "end_ms", "text")
    whole = F.struct(
        F.lit("relabel_run").alias("action"), F.col("run_index").alias("run_index"), F.col("first_pos").alias("lo"), F.col("last_pos").alias("hi"), F.col("speaker").alias("from_speaker"), target.alias("to_speaker"),
        anchors.alias("anchors"), how.alias("resolution"), F.col("text").alias("target_text"), beside_texts.alias("anchor_texts"), context_text(F.col("near"), shown(F.col("run_index"), own), anchors).alias("context"),
    )
    p = F.when(from_left, fragment(F.col("run_index") - 1, F.col("left_tail"), F.col("left_speaker"), "move_left_tail_to_candidate")).when(
        from_right, fragment(F.col("run_index") + 1, F.col("right_head"), F.col("right_speaker"), "move_right_head_to_candidate")
    ).when(~F.col("direct_visual") & target.isNotNull() & (target != F.col("speaker")), whole)
    c = c.withColumn("p", p)
    records = c.select(
        "video_id", "run_index", "speaker", "speech_ms", "left_same", "right_same", "direct_visual",
        F.when(from_left | from_right, F.col("p.resolution")).when(F.col("direct_visual"), "preserve_direct_visual").otherwise(how).alias("resolution"),
    )
    proposed = c.filter("p is not null").select("video_id", F.col("run_index").alias("candidate_run"), "p.*")
    verified = kept(verify(proposed) if verify_adjustments else proposed.withColumn("approved", F.lit(True)))
    approved = verified.filter("approved")
    # of several approved proposals of a run the last one counts in conflicts
    last = approved.groupBy("video_id", "run_index").agg(F.max(F.struct("candidate_run", "to_speaker", "anchors")).alias("l")).select("video_id", "run_index", "l.to_speaker", "l.anchors")
    bad = labels.conflicts(last).withColumn("conflict", F.lit(True))
    out = verified.join(bad, ["video_id", "run_index"], "left").withColumn("status", F.when(~F.coalesce("approved", F.lit(False)), "verifier_rejected").when(F.col("conflict"), "conflict").otherwise("applied")).drop("conflict")

    to = out.filter("status = 'applied'").select("video_id", F.explode(F.sequence("lo", "hi")).alias("index"), F.struct("candidate_run", "to_speaker", "action").alias("t")).groupBy("video_id", "index").agg(F.max("t").alias("t"))
    fixed = segments.join(to, ["video_id", "index"], "left")
    moved = F.col("t.to_speaker").isNotNull()
    before = lambda name: F.col(name) if name in segments.columns else F.lit(None).cast("string")
    # words first: inside a lambda a name means the new column of the same projection
    fixed = fixed.withColumn("words", F.when(moved, relabelled(F.col("words"), F.col("speaker"), F.col("t.to_speaker"), keep_original=True)).otherwise(F.col("words")))
    fixed = fixed.withColumns({
        "speaker_original": F.when(moved, F.coalesce(before("speaker_original"), F.col("speaker"))).otherwise(before("speaker_original")), "coverage_speaker": F.when(moved, F.coalesce(before("coverage_speaker"), F.col("speaker"))).otherwise(before("coverage_speaker")),
        "speaker_correction_action": F.col("t.action"), "correction_source": F.when(moved, "context_continuation").otherwise(before("correction_source")), "speaker": F.coalesce("t.to_speaker", "speaker"),
    }).drop("t")
    return Correction(fixed, out, records, borders)


def correction_audit(done: Correction) -> DataFrame:
    """SNK-15, AGG-22: counters of OP-04 by video: words moved, candidates, borders asked and skipped, proposals, corrections."""
    moves = done.segments.groupBy("video_id").agg(F.count_if(F.col("handed_on") > 0).alias("num_semantic_repairs"))
    n = done.candidates.groupBy("video_id").agg(F.count("*").alias("num_candidates"), F.count_if("direct_visual").alias("num_preserved"))
    b = done.borders.groupBy("video_id").agg(F.count_if(F.col("skipped_reason").isNull()).alias("num_asked"), F.count("skipped_reason").alias("num_skipped"))
    p = done.proposals.groupBy("video_id").agg(F.count("*").alias("num_proposals"), F.count_if(F.col("status") == "applied").alias("num_corrections"))
    counts = ["num_candidates", "num_preserved", "num_asked", "num_skipped", "num_proposals", "num_corrections"]
    return moves.join(n, "video_id", "left").join(b, "video_id", "left").join(p, "video_id", "left").fillna(0, counts)
