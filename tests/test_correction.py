"""Rules of the correction chain, by hand."""

import random

import pandas as pd
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import asking, captions, correction, labels
from turnloom.operators import intervals as I

RUN = "video_id long, run_index long, speaker string, start_ms long, end_ms long, speech_ms long, num_segments long, text string"


def _picked(spark, *runs):
    rows = [(1, k, s, 0, 0, ms, n, text) for k, (s, ms, n, text) in enumerate(runs)]
    return [r.run_index for r in labels.run_candidates(spark.createDataFrame(rows, RUN)).orderBy("run_index").collect()]


def test_candidates_of_two_runs(spark):
    assert _picked(spark, ("A", 1000, 1, ""), ("B", 2900, 1, "x")) == [0]  # the shorter one, even without text
    assert _picked(spark, ("A", 1000, 2, "x"), ("B", 2900, 1, "x")) == [1]  # the one of fewer segments
    assert _picked(spark, ("A", 1000, 2, "x"), ("B", 3100, 1, "x")) == [0]  # unless it is long
    assert _picked(spark, ("A", 1000, 1, "x"), ("A", 2000, 1, "x")) == []
    assert _picked(spark, ("A", 3100, 1, "x"), ("B", 3100, 1, "x")) == []


def test_candidates_of_many_runs(spark):
    assert _picked(spark, ("A", 1, 1, "x"), ("B", 1, 1, "x"), ("A", 1, 1, "x")) == [1]
    assert _picked(spark, ("A", 1, 1, "x"), ("B", 1, 1, ""), ("A", 1, 1, "x")) == []
    assert _picked(spark, ("A", 1, 1, "x")) == []


WORD = "start_ms long, end_ms long, word string, speaker string, matched_by string, overlap_ms long, coverage double, candidates array<struct<speaker:string,overlap_ms:long,coverage:double>>, overlap_margin_ms long, boundary_ambiguous boolean, reconcile_source string, reconcile_cov double, speaker_original string"
SEGMENT = f"video_id long, index long, speaker string, start_ms long, end_ms long, text string, words array<struct<{WORD.replace(' long', ':long').replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean').replace(' array', ':array')}>>, checked boolean"


def _segment(i, speaker, start, end, text, *, coverage=0.9, ambiguous=False, other=(), source="audio", checked=False):
    words = [(start, end, " " + text, speaker, "overlap", 1, coverage, [(s, 1, 0.4) for s in other], 0, ambiguous, source, None, None)]
    return (1, i, speaker, start, end, text, words, checked)


def _correct(spark, rows, same=True, approved=True):
    s = spark.createDataFrame(rows, SEGMENT)
    out, proposals, records, _ = correction.correct_segments(s, lambda b: b.withColumn("same", F.lit(same) if isinstance(same, bool) else F.col("run_index").isin(*same)), lambda p: p.withColumn("approved", F.lit(approved)))
    return {r["index"]: (r.speaker, r.speaker_original, [w.speaker for w in r.words]) for r in out.collect()}, proposals.collect(), records.collect()


def test_a_short_run_between_two_of_one_speaker(spark):
    rows = [_segment(0, "A", 0, 4000, "one"), _segment(1, "B", 4000, 5000, "two"), _segment(2, "A", 5000, 9000, "three")]
    got, proposals, _ = _correct(spark, rows)
    assert got[1] == ("A", "B", ["A"]) and [(p.action, p.resolution, p.status) for p in proposals] == [("relabel_run", "both_agree", "applied")]
    assert _correct(spark, rows, approved=False)[0][1][0] == "B"
    assert _correct(spark, rows, same=False)[1] == []


def test_faces_and_checked_segments_stay(spark):
    seen = [_segment(0, "A", 0, 4000, "one"), _segment(1, "B", 4000, 5000, "two", source="visual"), _segment(2, "A", 5000, 9000, "three")]
    got, proposals, records = _correct(spark, seen)
    assert got[1][0] == "B" and proposals == [] and records[0].resolution == "preserve_direct_visual"
    checked = [_segment(0, "A", 0, 4000, "one"), _segment(1, "B", 4000, 5000, "two", checked=True), _segment(2, "A", 5000, 9000, "three")]
    assert _correct(spark, checked)[2] == []


def test_a_weak_fragment_moves_instead(spark):
    rows = [_segment(0, "A", 0, 3000, "one"), _segment(1, "A", 3000, 3400, "uh", coverage=0.5, ambiguous=True, other=("A", "B")), _segment(2, "B", 3400, 5000, "two"), _segment(3, "C", 5000, 9000, "three")]
    got, proposals, records = _correct(spark, rows, same=(0,))  # only the border of the first two runs
    assert got[1] == ("B", "A", ["B"]) and got[2][0] == "B"
    assert [(p.action, p.run_index, p.to_speaker, p.resolution) for p in proposals] == [("move_boundary_fragment", 0, "B", "move_left_tail_to_candidate")] and records[0].resolution == "move_left_tail_to_candidate"
    for change in ({"coverage": 0.6}, {"ambiguous": False}, {"other": ("C",)}):
        other = [*rows]
        other[1] = _segment(1, "A", 3000, 3400, "uh", **({"coverage": 0.5, "ambiguous": True, "other": ("A", "B")} | change))
        assert _correct(spark, other, same=(0,))[1][0].action == "relabel_run"


def test_conflicting_proposals(spark):
    approved = spark.createDataFrame([(1, 1, "A", [0]), (1, 2, "C", [1, 3]), (1, 5, "A", [4])], "video_id long, run_index long, to_speaker string, anchors array<long>")
    assert sorted(r.run_index for r in labels.conflicts(approved).collect()) == [1, 2]


def test_repaired_span_merges(spark):
    rows = [_segment(0, "A", 0, 1000, "before"), _segment(1, "A", 2000, 3000, "I would"), _segment(2, "B", 3050, 4000, "rather not"), _segment(3, "C", 5000, 6000, "after")]
    s = spark.createDataFrame(rows, SEGMENT).withColumns({"overlap_ms": F.lit(1), "asr_segment_ids": F.array("index"), "match_methods": F.array(F.lit("overlap")), "coverage": F.lit(0.5), "boundary_ambiguous": F.lit(False), "source": F.lit("w")}).drop("checked")
    out, decisions = correction.repair_segments(s)
    got = out.orderBy("index").collect()
    assert [(r["index"], r.speaker, r.text, r.checked) for r in got] == [(0, "A", "before", False), (1, "A", "I would rather not", True), (2, "C", "after", False)]
    assert [w.speaker for w in got[1].words] == ["A", "A"] and got[1].asr_segment_ids == [1, 2]
    assert [(d.lo, d.hi, d.resolution) for d in decisions.collect()] == [(1, 2, "boundary_continuation")]


def test_window_of_a_span(spark):
    rows = [(1, k, s, 1000 * k + 5, 1000 * k + 900, f" line  {k}", 0, k) for k, s in enumerate("AABCC")]
    t = spark.createDataFrame(rows, "video_id long, pos long, speaker string, start_ms long, end_ms long, text string, span long, index long")
    spans = spark.createDataFrame([(1, 0, 1, 2, "A")], "video_id long, span long, lo long, hi long, left_label string")
    r = correction.span_texts(spans, t).first()
    lines = r.window.split("\n")
    assert r.left_text == "line 1" and lines[1:] == ['  (BEFORE) "line 0"', '  [0.10s] U >> "line 1 line 2"', '  [0.10s] (AFTER) "line 3"', '  [0.10s] "line 4"']


def test_client_is_built_once_a_partition(spark):
    def make():
        built = []
        built.append(1)
        return lambda batch: pd.Series([len(t) > 3 and len(built) == 1 for t in batch.left_text])

    rows = spark.createDataFrame([("long text",), ("no",)], "left_text string").coalesce(1)
    assert [r.same for r in asking.asked_of(make, "same", "boolean")(rows).collect()] == [True, False]


def test_translations_keep_what_is_there(spark):
    cues = spark.createDataFrame([(1, 0, "a", "done"), (1, 1, " b ", None), (1, 2, " ", None), (1, 3, "c", None)], "video_id long, index long, text string, text_ko string")
    some = lambda rows: rows.filter("text <> 'c'").withColumn("text_ko", F.upper("text"))
    got = {r["index"]: r.text_ko for r in captions.translated(cues, some, batch=2).collect()}
    assert got == {0: "done", 1: "B", 2: None, 3: None}
    assert {r["index"]: r.text_ko for r in captions.translated(cues, some, overwrite=True).collect()}[0] == "A"


def test_cues_are_cut_once(spark):
    words = [(0, 900, " One.", "A"), (1000, 1900, " Two", "A"), (2000, 2900, " three.", "A")]
    s = spark.createDataFrame([(1, 0, "A", 0, 2900, "One. Two three.", words)], "video_id long, index long, speaker string, start_ms long, end_ms long, text string, words array<struct<start_ms:long,end_ms:long,word:string,speaker:string>>")
    first = captions.cue_chain(s)
    assert sorted((r["index"], r.text, r.text_ko, r.speaker) for r in first.collect()) == [(0, "One.", "One.", "A"), (1, "Two three.", "Two three.", "A")]
    again = captions.cue_chain(first.withColumn("words", F.array().cast(dict(s.dtypes)["words"])))
    assert sorted((r["index"], r.text) for r in again.collect()) == [(0, "One."), (1, "Two three.")]


def test_timeline_ends_with_the_recording(spark):
    cues = spark.createDataFrame([(1, 0, 100, 200), (1, 1, 2000, 2100)], "video_id long, pos long, start_ms long, end_ms long")
    total = spark.createDataFrame([(1, 2500)], "video_id long, total_ms long")
    got = [(r.pos, r.duration_ms) for r in I.timeline_entries(I.timeline(cues, total)).orderBy("entry").collect()]
    assert got == [(None, 100), (0, 1200), (None, 700), (1, 500)]
    assert [r.held_ms for r in I.timeline(cues).orderBy("pos").collect()] == [1300, 2100]


def test_small_functions(spark):
    df = spark.createDataFrame([("..", "a/b", "#12345", "ok_1")], "a string, b string, c string, d string")
    assert tuple(df.select(*[T.safe_child(F.col(c)) for c in "abd"], T.hex_ass(F.col("c"))).first()) == (None, None, "ok_1", "&HFFFFFF")
    units = F.array(F.array(F.struct(F.lit("a").alias("unit"), F.lit(False).alias("picture"))), F.array(F.struct(F.lit("b").alias("unit"), F.lit(True).alias("picture"))))
    assert [tuple(u) for u in df.select(T.stacked_units(units)).first()[0]] == [("a", False), ("\n", False), ("b", True)]
    tags = spark.createDataFrame([("<a>",), ("> x",), ("<|en|><|HAPPY|>> hi <b>",)], "t string").select(*T.parsed_tags(F.col("t"))).collect()
    assert [tuple(r) for r in tags] == [("a", ""), ("|EMO_UNKNOWN|", "x"), ("|HAPPY|", "hi")]


# words that move to the next face


def _spoken(i, speaker, start, *tokens, seen=True, labels=None):
    words = [(start + 300 * k, start + 300 * k + 290, w, (labels or [None] * len(tokens))[k], "overlap", 290, 0.9, [], None, False, "visual" if seen else "audio", None, None) for k, w in enumerate(tokens)]
    return (1, i, speaker, start, start + 300 * len(tokens) - 10, "".join(tokens).strip(), words, False)


def _moved(spark, rows):
    return {r["index"]: r for r in correction.moved_openers(spark.createDataFrame(rows, SEGMENT)).collect()}


def test_an_opener_moves_to_the_face_that_says_it(spark):
    got = _moved(spark, [_spoken(0, "S0", 0, " One", " end.", " So"), _spoken(1, "FACE_1", 900, " it", " goes."), _spoken(2, "FACE_2", 5000, " far", " off")])
    assert (got[0].text, got[0].end_ms, got[1].text, got[1].start_ms) == ("One end.", 590, "So it goes.", 600)
    assert [(w.word, w.speaker, w.speaker_original, w.correction_source) for w in got[1].words][0] == (" So", "FACE_1", "S0", "semantic_boundary_word")
    assert [w.correction_source for w in got[0].words] == [None, None] and (got[0].handed_on, got[1].received, got[2].received) == (1, 1, 0)
    done = correction.correct_segments(spark.createDataFrame([_spoken(0, "S0", 0, " One", " end.", " So"), _spoken(1, "FACE_1", 900, " it", " goes.")], SEGMENT))
    assert {r["index"]: r.text for r in done.segments.collect()} == {0: "One end.", 1: "So it goes."}


def test_an_opener_stays(spark):
    face = _spoken(1, "FACE_1", 900, " it", " goes.")
    for left, right in [
        (_spoken(0, "S0", 0, " One", " end", " So"), face), (_spoken(0, "FACE_1", 0, " One", " end.", " So"), face), (_spoken(0, "S0", 0, " One", " end.", " So"), _spoken(1, "S1", 900, " it", " goes.")),
        (_spoken(0, "S0", 0, " One", " end.", " So"), _spoken(1, "FACE_1", 900, " it", " goes.", seen=False)), (_spoken(0, "S0", 0, " One", " end.", " So"), _spoken(1, "FACE_1", 995, " it", " goes.")),
        (_spoken(0, "S0", 0, " One", " end.", " So", labels=["S0", "S0", "S9"]), face), (_spoken(0, "S0", 600, " So."), face), (_spoken(0, "S0", -300, " One.", " a", " b", " c"), face),
    ]:
        got = _moved(spark, [left, right])
        assert [got[i].text for i in (0, 1)] == [left[5], right[5]]


def plain_moves(segments):
    """One border after the other; segments: speaker, start, end, words of (start, end, token), and whether a face speaks for it."""
    s = [[sp, w[0][0], w[-1][1], list(w), seen] for sp, w, seen in segments]
    for left, right in zip(s, s[1:], strict=False):
        words = left[3]
        if left[0] == right[0] or not right[0].startswith("FACE_") or abs(right[1] - left[2]) > 100 or not right[4]:
            continue
        for size in range(1, min(2, len(words) - 1) + 1):
            if words[-size - 1][2].strip()[-1] in ".!?" and sum(b - a for a, b, _ in words[-size:]) <= 650:
                right[3][:0], left[3][-size:] = words[-size:], []
                left[2], right[1] = left[3][-1][1], right[3][0][0]
                break
    return ["".join(w for _, _, w in x[3]).strip() for x in s]


def test_moves_equal_border_by_border(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for video in range(60):
        at, own = 0, []
        for i in range(12):
            speaker, n, seen = rnd.choice(["FACE_1", "FACE_2", "FACE_3", "S0"]), rnd.choice([1, 1, 1, 2, 2, 3, 4]), rnd.random() < 0.9
            words = []
            for _ in range(n):
                words.append((at, at + rnd.choice([100, 290, 400]), " " + rnd.choice(["a", "b.", "c!", "d"])))
                at = words[-1][1] + 10
            at += rnd.choice([0, 0, 0, 200])
            own.append((speaker, words, seen))
            rows.append((video, i, speaker, words[0][0], words[-1][1], "".join(w for _, _, w in words).strip(), [(a, b, w, speaker, "overlap", 1, 0.9, [], None, False, "visual" if seen else "audio", None, None) for a, b, w in words], False))
        want |= {(video, i): t for i, t in enumerate(plain_moves(own))}
    got = correction.moved_openers(spark.createDataFrame(rows, SEGMENT)).collect()
    assert {(r.video_id, r["index"]): r.text for r in got} == want
    assert sum(r.received for r in got) > 50 and any(r.received and r.handed_on and len(r.words) < 3 for r in got)


def test_contexts_of_judge_and_verifier(spark):
    rows = [_segment(k, s, 4000 * k, 4000 * k + ms, f"t{k}") for k, (s, ms) in enumerate([("A", 3900), ("B", 3900), ("A", 3900), ("C", 900), ("B", 3900), ("A", 3900)])]
    shown = {}

    def judge(b):
        shown["borders"] = b.collect()
        return b.withColumn("same", F.lit(True))

    def verify(p):
        shown["proposals"] = p.collect()
        return p.withColumn("approved", F.lit(True))

    done = correction.correct_segments(spark.createDataFrame([(*r[:7], k in (1, 2, 4)) for k, r in enumerate(rows)], SEGMENT), judge, verify, max_gap_ms=10_000)
    lines = lambda text: [x.split(":")[0].split(" [")[0] for x in text.split("\n")[1:]]
    assert {b.run_index: (b.candidate_run, lines(b.context)) for b in shown["borders"]} == {2: (3, ["RUN_2", "RUN_3", "RUN_4"]), 3: (3, ["RUN_2", "RUN_3", "RUN_4"])}
    assert shown["proposals"] == []  # the neighbours don't agree
    assert [(b.run_index, b.skipped_reason, b.same) for b in done.borders.orderBy("run_index").collect()] == [(2, None, True), (3, None, True)]
    rows = [_segment(0, "A", 0, 4000, "one"), _segment(1, "B", 4000, 5000, "two"), _segment(2, "A", 5000, 9000, "three")]
    correction.correct_segments(spark.createDataFrame(rows, SEGMENT), judge, verify)
    p = shown["proposals"][0]
    assert (p.target_text, p.anchor_texts) == ("two", ["one", "three"])
    assert p.context.split("\n")[1:] == ["RUN_0 [ANCHOR] [0.00-4.00]: one", "RUN_1 [TARGET] [4.00-5.00]: two", "RUN_2 [ANCHOR] [5.00-9.00]: three"]
    rows = [_segment(0, "A", 0, 3000, "one"), _segment(1, "A", 3000, 3400, "uh", coverage=0.5, ambiguous=True, other=("A", "B")), _segment(2, "B", 3400, 5000, "two"), _segment(3, "C", 9000, 12_900, "three")]
    done = correction.correct_segments(spark.createDataFrame(rows, SEGMENT), judge, verify)
    assert shown["proposals"][0].context.split("\n")[1:3] == ["RUN_0 [TARGET] [3.00-3.40]: uh", "RUN_1 [ANCHOR] [3.40-5.00]: two"]
    assert [(b.run_index, b.skipped_reason) for b in done.borders.orderBy("run_index").collect()] == [(0, None), (1, "gap_too_large")]
    assert {r["index"]: r.correction_source for r in done.segments.collect()} == {0: None, 1: "context_continuation", 2: None, 3: None}
