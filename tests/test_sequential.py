"""Properties, brute force and cases worked out by hand."""

import itertools
import random
import textwrap

import numpy as np
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import sequential as S


def _timed(rng, n):
    t, starts, ends = 0, [], []
    for _ in range(n):
        starts.append(t)
        t += rng.randrange(50, 900)
        ends.append(t)
        t += rng.choice([0, 0, 100, 400])
    kind = [rng.choice(["", "", "", "soft", "sentence"]) for _ in range(n)]
    return starts, ends, [k == "sentence" for k in kind], [k != "" for k in kind]


def test_cues_are_readable():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(1, 40)
        starts, ends, sentence, soft = _timed(rng, n)
        cuts = S.cue_cuts(starts, ends, sentence, soft)
        assert cuts == sorted(set(cuts)) and cuts[-1] == n
        leaves = lambda c: n - c >= 2 and ends[-1] - starts[c] >= 750  # noqa: E731, B023
        for lo, hi in itertools.pairwise([0, *cuts]):
            good = [c for c in range(lo + 1, min(hi + 1, n)) if ends[c - 1] - starts[lo] >= 750 and leaves(c)]
            if hi < n:
                assert leaves(hi)  # no cut leaves a rest that can't be read
                limit = ends[hi - 1] - starts[lo] >= 3500 or hi - lo >= 12
                assert hi in good or limit
                if sentence[hi - 1] and hi in good:  # the first sentence end that will do, before any limit
                    assert not any(sentence[c - 1] for c in good if c < hi)
            assert not any(sentence[c - 1] for c in good if c < hi and c - lo < 12 and ends[c - 1] - starts[lo] < 3500)


def test_cues_by_hand():
    half = lambda n: ([500 * k for k in range(n)], [500 * k + 500 for k in range(n)])
    no = [False] * 20
    mark = lambda *at: [k in at for k in range(20)]
    assert S.cue_cuts(*half(3), no[:3], no[:3]) == [3]
    assert S.cue_cuts(*half(6), mark(1)[:6], mark(1)[:6]) == [2, 6]  # a second is enough, and two are left
    assert S.cue_cuts(*half(6), mark(0)[:6], mark(0)[:6]) == [6]  # half a second isn't
    assert S.cue_cuts(*half(5), mark(3)[:5], mark(3)[:5]) == [5]  # one word would be left
    assert S.cue_cuts(*half(10), no[:10], mark(4)[:10]) == [5, 10]  # at the limit of 3.5 s, back to the comma
    assert S.cue_cuts(*half(10), no[:10], no[:10]) == [7, 10]  # or there
    quick = ([100 * k for k in range(20)], [100 * k + 100 for k in range(20)])
    assert S.cue_cuts(*quick, no, no) == [12, 20]  # twelve words


def test_cues_of_words(spark):
    rows = [(1, 0, k, 500 * k, 500 * k + 500, w) for k, w in enumerate([" Hello", " there", ".", " Dr.", " Who", " is", " here", " now"])]
    rows += [(1, 1, 0, 0, 400, " late"), (1, 1, 1, 300, 700, " early"), (1, 2, 0, 0, 10, " one")]
    got = S.split_cues(spark.createDataFrame(rows, "video_id long, parent_index long, word_index long, start_ms long, end_ms long, word string")).orderBy("parent_index", "part").collect()
    assert [(r.parent_index, r.part, r.part_count, r.start_ms, r.end_ms, r.text) for r in got] == [(0, 1, 2, 0, 1500, "Hello there."), (0, 2, 2, 1500, 4000, "Dr. Who is here now"), (1, 1, 1, 0, 700, "late early"), (2, 1, 1, 0, 10, "one")]


def test_joined(spark):
    cases = [(["Hello", " there", ",", "you", " "], "Hello there, you"), ([" a", "b", "...", None][:3], "a b..."), (["x", ")", "(y", "\u3000z "], "x) (y\u3000z"), ([], ""), (["", "  "], "")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t array<string>")
    assert [r[0] for r in df.select(T.joined(F.col("t"))).collect()] == [want for _, want in cases]


def test_sentence_ends(spark):
    cases = [("end.", True, True), ("Dr.", False, False), ("no", False, False), ("well, ", False, True), ("끝。", False, False), ("what？", True, True), ("", False, False)]
    got = spark.createDataFrame([(c[0],) for c in cases], "t string").select(T.ends_sentence(F.col("t")), T.ends_phrase(F.col("t")), T.ends_sentence(F.col("t"), T.MOVE_ENDS, ())).collect()
    assert [tuple(r)[:2] for r in got] == [c[1:] for c in cases] and got[1][2] and got[4][2]


def test_break_penalties(spark):
    cases = [("end.\"", "next", -0.12), ("했는데", "그", -0.06), ("있을", "수도", 0.30), ("하고", "싶다", 0.20), ("가면서,", "(것은", 0.18), ("a", "b", 0.0)]
    got = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(T.break_penalty(F.col("a"), F.col("b"))).collect()
    assert all(abs(r[0] - c[2]) < 1e-12 for r, c in zip(got, cases, strict=True))


def test_lines_cost_least():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 9)
        widths, costs, room, space = [rng.randrange(1, 9) for _ in range(n)], [rng.choice([-0.12, 0.0, 0.3]) for _ in range(n - 1)], 10, 1

        def cost(ends):
            total = 0.0
            for lo, hi in itertools.pairwise([0, *ends]):  # noqa: B023
                w = sum(widths[lo:hi]) + space * (hi - lo - 1)  # noqa: B023
                if w > room and hi - lo > 1:  # noqa: B023
                    return float("inf")
                total += max(room - w, 0) ** 2 / room**2 + (costs[hi - 1] if hi < n else 0)  # noqa: B023
            return total

        every = [[*c, n] for k in range(n) for c in itertools.combinations(range(1, n), k)]
        assert abs(cost(S.line_ends(widths, costs, space, room)) - min(map(cost, every))) < 1e-9
    assert S.line_ends([], [], 1, 5) == [] and S.line_ends([9], [], 1, 5) == [1]


def test_wrapped_texts(spark):
    got = S.wrap_lines(spark.createDataFrame([("a", ["aa", "bb", "cc", "dd"]), ("b", [])], "id string, words array<string>"), room=5.0).collect()
    assert {r.id: r.lines for r in got} == {"a": ["aa bb", "cc dd"], "b": []}
    narrow = S.wrap_lines(spark.createDataFrame([("a", ["ii", "ii", "ii", "mm"])], "id string, words array<string>"), advances={"i": 0.25, "m": 2.0}, room=5.0, space=1.0)
    assert narrow.first().lines == ["ii ii ii", "mm"]  # 0.5 each and two blanks; four
    assert spark.range(1).select(S.text_width(F.lit("imx"), {"i": 0.25, "m": 2.0}, 0.5), S.text_width(F.lit(""), {"i": 1.0})).first()[:] == (2.75, 0.0)


def test_wrapped_like_the_text_library(spark):
    r = random.Random(1)
    parts = ["a", "bb", "ccc-dd", "e-f", "x--y", "foo---bar", "well-known", "étre-là", "  ", " ", "\t", "\n", "12-34", "z" * 50, "-", "--", "a.-b", " q ", "日本語-日本"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(500)] + ["", " ", "\t", "a" * 60]
    got = {x.i: x.w for x in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.wrapped(F.col("t"), 20).alias("w")).collect()}
    assert got == {i: "\n".join(textwrap.wrap(t, width=20, break_long_words=False)) for i, t in enumerate(texts)}


def plain_linkage(vectors, cut):
    """The two nearest clusters merge, again and again; mean distances worked out pair by pair."""
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
    pair = 1 - unit @ unit.T
    clusters = [[i] for i in range(len(vectors))]
    while len(clusters) > 1:
        far, i, j = min((round(pair[np.ix_(a, b)].mean(), 12), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(clusters), 2))
        if far >= cut:
            break
        clusters[i] += clusters.pop(j)
    label = {}
    for k, c in enumerate(sorted(clusters, key=min)):
        label |= dict.fromkeys(c, k)
    return [label[i] for i in range(len(vectors))]


def test_average_linkage():
    rng = np.random.default_rng(0)
    for n, dims, cut in [(1, 4, 0.7), (2, 4, 0.7), (12, 3, 0.3), (30, 5, 0.7), (40, 8, 0.9), (40, 2, 0.05), (25, 3, 5.0)]:
        v = rng.normal(size=(n, dims))
        assert S.average_linkage(v, cut).tolist() == plain_linkage(v, cut)
        tied = np.concatenate([v, v[: n // 2], -v[: n // 3]])  # equal vectors, and opposite ones
        assert S.average_linkage(tied, cut).tolist() == plain_linkage(tied, cut)
    assert S.average_linkage(np.zeros((0, 3))).tolist() == []


def test_five_thousand_tracks_in_a_group():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(50, 64))
    own = rng.integers(0, 50, 5000)
    labels = S.average_linkage(centres[own] + rng.normal(0, 0.1, (5000, 64)), 0.3)
    assert len(set(labels)) == len(set(zip(labels.tolist(), own.tolist(), strict=True))) == 50


def test_clusters_of_each_video(spark):
    rows = [(v, t, [1.0, 0.0] if (t + v) % 2 else [0.0, 1.0]) for v in (0, 1) for t in range(5)]
    got = {(r.video_id, r.track): r.face_id for r in S.cluster_tracks(spark.createDataFrame(rows, "video_id int, track int, embedding array<float>")).collect()}
    assert got == {(v, t): t % 2 for v in (0, 1) for t in range(5)}


def _video(seed, frames):
    r = random.Random(seed)
    rows = []
    for f in sorted(r.sample(range(3 * frames), frames)):
        for k in range(r.randint(0, 4)):
            x, y, side = r.randint(0, 60), r.randint(0, 10), r.randint(5, 20)
            rows.append((seed, f, k, x, y, x + side, y + side))
    return rows


def plain_overlaps(rows, least=0.5, gap=10):
    """Pass by pass over all frames, each taking one track's boxes out of lists that it walks through."""
    frames = [[list(r) for r in own] for _, own in itertools.groupby(rows, lambda r: r[1])]
    out, n = {}, 0
    while any(frames):
        last = None
        for frame in frames:
            for box in frame:  # the list shrinks under the loop, so what follows a taken box is passed over
                if last is not None and box[1] - last[1] > gap:
                    break
                if last is None or S._iou(np.array(box[3:], float), np.array(last[3:], float)) > least:
                    out[tuple(box[:3])], last = n, box
                    frame.remove(box)
        n += 1
    return out


def test_overlap_tracks_equal_pass_by_pass(spark):
    rows = [r for seed in range(12) for r in _video(seed, 40)]
    df = spark.createDataFrame(rows, "video_id long, frame long, box long, x1 int, y1 int, x2 int, y2 int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # frames go on from batch to batch
    try:
        got = {(r.video_id, r.frame, r.box): r.track for r in S.overlap_tracks(df).collect()}
        want = {}
        for _, own in itertools.groupby(rows, lambda r: r[0]):
            want |= plain_overlaps(list(own))
        assert got == want
        centred = df.selectExpr("video_id", "frame", "box", "x1 AS x", "y1 AS y", "x2 - x1 AS w", "y2 - y1 AS h")
        tracks = {(r.video_id, r.frame, r.box): r.track for r in S.centre_tracks(centred).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for seed in range(12):
        centres = []
        for _, f, k, x1, y1, x2, y2 in (r for r in rows if r[0] == seed):
            c = ((x1 + x2) / 2, (y1 + y2) / 2)
            far = [np.hypot(c[0] - a, c[1] - b) for a, b in centres]
            own = far.index(min(far)) if far and min(far) < (x2 - x1) / 2 else len(centres)
            centres[own : own + 1] = [c]
            assert tracks[seed, f, k] == own


def test_trackers_hold_open_tracks_only():
    t = S.OverlapTracks(0.5, 10)
    for f in range(20_000):
        t.frame(f * 20 if f % 50 == 0 else f * 20 + 1, np.array([[f % 7 * 100.0, 0, f % 7 * 100 + 50, 50]]))
    assert len(t.open) == 1 and t.n == 20_000


def test_tracks_by_hand(spark):
    at = lambda f, k, x: (1, f, k, x, 0, x + 10, 10)
    rows = [at(0, 0, 0), at(0, 1, 100), at(1, 0, 1), at(1, 1, 101), at(3, 0, 102), at(30, 0, 2)]
    got = {(r.frame, r.box): r.track for r in S.overlap_tracks(spark.createDataFrame(rows, "video_id long, frame long, box long, x1 int, y1 int, x2 int, y2 int")).collect()}
    assert got == {(0, 0): 0, (1, 0): 0, (0, 1): 1, (1, 1): 1, (3, 0): 1, (30, 0): 2}
    centres = [(1, 0, 0, 0, 0, 10, 10), (1, 0, 1, 50, 0, 10, 10), (1, 1, 0, 52, 0, 10, 10), (1, 1, 1, 20, 0, 10, 10)]
    got = {(r.frame, r.box): r.track for r in S.centre_tracks(spark.createDataFrame(centres, "video_id long, frame long, box long, x int, y int, w int, h int")).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 2}


def test_filled_tracks(spark):
    rows = [(1, 0, f, f, 0, f + 10, 10) for f in (*range(10), 14)] + [(1, 1, f, 0, 0, 5, 5) for f in range(10)]
    got = {(r.track, r.frame): r.x1 for r in S.filled_tracks(spark.createDataFrame(rows, "video_id long, track long, frame long, x1 int, y1 int, x2 int, y2 int")).collect()}
    assert got == {(0, f): float(f) for f in range(15)}  # ten boxes aren't enough for the other


def test_equal_spreads_go_to_the_first_track(spark):
    rows = [(clip, track, f, 80, (x + 3 * track) / 400) for clip, line in enumerate(itertools.permutations((0, 7, 14, 98))) for track in (0, 1) for f, x in enumerate(line)]
    got = S.speaking_tracks(spark.createDataFrame(rows, "clip long, track long, frame long, width int, opening double")).collect()
    assert {(r.clip, r.track) for r in got} == {(clip, 0) for clip in range(24)} and {round(r.motion, 9) for r in got} == {0.09928455}
