"""Rules in which each step's outcome changes the next one's input.

What can be a column is one: the tests of words, costs and texts run in the JVM. Only the narrow step that depends on its own
last outcome is Python, over arrays of one segment or a few numbers for each segment of a video. Times are integer milliseconds.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.text import MOVE_ENDS, break_penalty, ends_phrase, ends_sentence, joined, stripped

#: Fixed values of the cue rules and of face tracks.
MIN_CUE_MS, MAX_CUE_MS, MAX_CUE_WORDS = 750, 3500, 12
TRACK_IOU, TRACK_GAP, TRACK_FRAMES, TRACK_SIZE = 0.5, 10, 10, 1


def cue_cuts(starts, ends, sentence, soft) -> list[int]:
    """WIN-19: exclusive ends of the cues of one segment's words; sentence and soft: where a word ends a sentence, or at least a phrase."""
    starts, ends, sentence, soft = (np.asarray(x) for x in (starts, ends, sentence, soft))
    n = len(starts)
    cut = np.arange(1, n + 1)
    # what would be left after a cut has to be nothing, or two words and MIN_CUE_MS at least
    viable = cut == n
    viable[:-1] = (n - cut[:-1] >= 2) & (ends[-1] - starts[1:] >= MIN_CUE_MS)
    out, at = [], 0
    while at < n:
        lasts = ends[at:] - starts[at]
        readable = (lasts >= MIN_CUE_MS) & viable[at:]
        inner = cut[at:] < n
        full = inner & ((lasts >= MAX_CUE_MS) | (cut[at:] - at >= MAX_CUE_WORDS))
        # the last readable soft border up to each place, or 0
        border = np.maximum.accumulate(np.where(readable & soft[at:], cut[at:], 0))
        target = np.where(inner & readable & sentence[at:], cut[at:], np.where(full & (border > 0), border, np.where(full & viable[at:], cut[at:], 0)))
        hit = np.flatnonzero(target)
        at = int(target[hit[0]]) if len(hit) else n
        out.append(at)
    return out


def valid_words(words: Column) -> Column:
    """PRJ-18: at least two words, none blank, none that ends before it starts or starts before the last one's end."""
    order = F.forall(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.get(words, i)["start_ms"] >= F.get(words, i - 1)["end_ms"])
    good = F.forall(words, lambda w: F.coalesce((stripped(w["word"]) != "") & (w["end_ms"] >= w["start_ms"]), F.lit(False)))
    return F.when(F.size(words) < 2, False).otherwise(good & F.coalesce(order, F.lit(False)))


def split_cues(words: DataFrame) -> DataFrame:
    """WIN-19, WIN-16, FN-07. words: video_id, parent_index, word_index, start_ms, end_ms, word. One row for each cue; a segment whose words aren't valid stays one."""
    word = F.struct("word_index", "start_ms", "end_ms", "word", ends_sentence(F.col("word")).alias("sentence"), ends_phrase(F.col("word")).alias("soft"))
    rows = words.groupBy("video_id", "parent_index").agg(F.sort_array(F.collect_list(word)).alias("w")).withColumn("valid", valid_words(F.col("w")))

    def run(batches):
        for b in batches:
            w, valid = b.column("w"), b.column("valid").to_pylist()
            flat, offsets = w.flatten(), w.offsets.to_numpy() - w.offsets[0].as_py()
            start, end, sentence, soft = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("start_ms", "end_ms", "sentence", "soft"))
            cuts = [cue_cuts(start[i:j], end[i:j], sentence[i:j], soft[i:j]) if ok else [j - i] for i, j, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cuts, pa.list_(pa.int32()))], names=["video_id", "parent_index", "w", "cuts"])

    kinds = dict(rows.dtypes)
    cut = rows.mapInArrow(run, f"video_id {kinds['video_id']}, parent_index {kinds['parent_index']}, w {kinds['w']}, cuts array<int>")
    parts = cut.select("video_id", "parent_index", "w", "cuts", F.posexplode("cuts").alias("k", "hi"))
    lo = F.when(F.col("k") == 0, 0).otherwise(F.get("cuts", F.col("k") - 1))
    own = parts.select("video_id", "parent_index", (F.col("k") + 1).cast("bigint").alias("part"), F.size("cuts").cast("bigint").alias("part_count"), F.slice("w", lo + 1, F.col("hi") - lo).alias("w"))
    return own.select(
        "video_id", "parent_index", "part", "part_count", F.get("w", F.lit(0))["start_ms"].alias("start_ms"), F.element_at("w", -1)["end_ms"].alias("end_ms"),
        joined(F.transform("w", lambda x: x["word"])).alias("text"), F.size("w").cast("bigint").alias("num_words"),
    )


def line_ends(widths, penalties, space: float, room: float) -> list[int]:
    """WIN-21: exclusive ends of the lines of least total cost: squared slack, and the penalty of the break after each line but the last."""
    widths = np.asarray(widths, float)
    n = len(widths)
    edge = np.concatenate([[0.0], np.cumsum(widths + space)])  # where word i begins, on one long line
    after = np.append(np.asarray(penalties, float)[: max(n - 1, 0)], 0.0)
    best, stop = np.zeros(n + 1), np.full(n + 1, n)
    for i in range(n - 1, -1, -1):
        wide = edge[i + 1 :] - edge[i] - space
        fits = max(1, int(np.searchsorted(wide, room, "right")))  # a word wider than the room has a line of its own
        cost = np.maximum(room - wide[:fits], 0) ** 2 / room**2 + after[i : i + fits] + best[i + 1 : i + 1 + fits]
        k = int(np.argmin(cost))
        best[i], stop[i] = cost[k], i + 1 + k
    out, i = [], 0
    while i < n:
        i = int(stop[i])
        out.append(i)
    return out


def text_width(text: Column, advances: dict[str, float] | None = None, other: float = 1.0) -> Column:
    """The sum of the characters' advances, those of a font, `other` for what has none of its own."""
    if not advances:
        return F.length(text) * other
    table = F.create_map(*[F.lit(x) for c, w in advances.items() for x in (c, float(w))])
    return F.aggregate(F.split(text, ""), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(F.coalesce(F.try_element_at(table, c), F.lit(float(other)))))


def wrap_lines(texts: DataFrame, *, advances: dict[str, float] | None = None, letter: float = 1.0, space: float = 1.0, room: float = 44.0) -> DataFrame:
    """WIN-21: texts(id, words array<string>) with lines; widths are the characters' advances, `letter` for each that has none."""
    penalty = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: break_penalty(F.get("words", i - 1), F.get("words", i)))
    rows = texts.select("id", "words", F.transform("words", lambda w: text_width(w, advances, letter)).cast("array<double>").alias("widths"), F.when(F.size("words") > 1, penalty).otherwise(F.array().cast("array<double>")).alias("penalties"))

    def run(batches):
        for b in batches:
            ends = [line_ends(w, p, space, room) for w, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends, pa.list_(pa.int32()))], names=["id", "words", "ends"])

    out = rows.mapInArrow(run, f"id {dict(texts.dtypes)['id']}, words array<string>, ends array<int>")
    line = F.transform("ends", lambda hi, k: F.array_join(F.slice("words", F.when(k == 0, 0).otherwise(F.get("ends", k - 1)) + 1, hi - F.when(k == 0, 0).otherwise(F.get("ends", k - 1))), " "))
    return out.select("id", line.alias("lines"))


#: Where a line may be broken: beside blanks, after a hyphen with letters on both sides, and beside dashes between words.
_WRAP_AT = r"(?U)(?<= )(?=[^ ])|(?<=[^ ])(?= )|(?:(?<=[^\d\W]{2}-)|(?<=[^\d\W]-[^\d\W]-))(?=[^\d\W]-?[^\d\W])|(?<=[\w!\"'&.,?])(?=-{2,}\w)|(?<=[\w!\"'&.,?]-{2,9})(?=\w)"


def wrapped(text: Column, width: int = 44) -> Column:
    """FN-06: lines of at most `width` characters, words whole; a longer word has a line of its own. White space counts as blanks, tabs reach to the next
    multiple of eight; blanks go at the ends of lines and at the beginnings of all but the first."""
    tabs = F.split(F.translate(F.coalesce(text, F.lit("")), "\r", "\n"), "\t")
    column = lambda a: F.length(F.substring_index(a, "\n", -1))
    spread = F.aggregate(F.slice(tabs, F.lit(2), F.size(tabs)), F.get(tabs, F.lit(0)), lambda a, x: F.concat(a, F.repeat(F.lit(" "), 8 - column(a) % 8), x))
    spread = F.translate(spread, "\n\x0b\x0c", "   ")

    def add(done, piece):
        lines, line = done["lines"], done["line"]
        both = lambda lines, line: F.struct(lines.alias("lines"), line.alias("line"))
        blank = F.trim(piece) == ""
        ended = F.when(F.rtrim(line) == "", lines).otherwise(F.concat(lines, F.array(F.rtrim(line))))
        fits = (F.length(line) + F.length(piece) <= width) | (line == "")
        return F.when(blank & (line == "") & (F.size(lines) > 0), done).when(fits, both(lines, F.concat(line, piece))).otherwise(both(ended, F.when(blank & (F.size(ended) > 0), "").otherwise(piece)))

    last = lambda d: F.array_join(F.when(F.rtrim(d["line"]) == "", d["lines"]).otherwise(F.concat(d["lines"], F.array(F.rtrim(d["line"])))), "\n")
    return F.aggregate(F.split(spread, _WRAP_AT), F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line")), add, last)


def average_linkage(vectors: np.ndarray, cut: float = 0.7) -> np.ndarray:
    """AGG-19: labels of agglomerative clustering by cosine distance, average linkage, stopped at `cut`.

    Chains of nearest neighbours: the two at a chain's end, nearest to each other, merge, whatever lies elsewhere. The mean distance of two
    clusters is 1 - (their sums' product) / (their sizes' product), so there is no matrix of distances: memory is that of the vectors, time is quadratic in
    their number. What is nearest to nothing within `cut` is done, as merges elsewhere bring nothing nearer.
    """
    n = len(vectors)
    sums = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
    size, root, at = np.ones(n), np.arange(n), np.arange(n)  # at: which vector each row of sums began with
    open_, chain = np.ones(n, bool), []
    begin = 0
    while True:
        if not chain:
            left = np.flatnonzero(open_[begin:])
            if not len(left):
                break
            begin += int(left[0])
            if open_.sum() < len(open_) // 2:  # rows that are done go, so later steps are shorter
                sums, size, at = sums[open_], size[open_], at[open_]
                open_, begin = np.ones(len(at), bool), 0
            chain = [begin]
        x = chain[-1]
        far = np.where(open_, 1 - (sums @ sums[x]) / (size * size[x]), np.inf)
        far[x] = np.inf
        y = int(far.argmin())
        if len(chain) > 1 and far[chain[-2]] <= far[y]:
            y = chain[-2]
        if far[y] >= cut:
            open_[x] = False
            chain.pop()
        elif len(chain) > 1 and y == chain[-2]:
            i, j = sorted((x, y))
            sums[i] += sums[j]
            size[i] += size[j]
            open_[j] = False
            root[at[j]] = at[i]
            del chain[-2:]
        else:
            chain.append(y)
    while (root[root] != root).any():
        root = root[root]
    return np.unique(root, return_inverse=True)[1]


def cluster_tracks(tracks: DataFrame, *, cut: float = 0.7) -> DataFrame:
    """AGG-19: tracks (video_id, track, embedding) with face_id. A video's vectors are one group, as each merge depends on all of them; that group takes the memory of its vectors."""
    kinds = dict(tracks.dtypes)

    def of_video(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("track")
        vectors = np.stack(rows.column("embedding").to_numpy()).astype(float) if len(rows) else np.zeros((0, 1))
        return pa.table({"video_id": rows.column("video_id"), "track": rows.column("track"), "face_id": pa.array(average_linkage(vectors, cut), pa.int64())})

    return tracks.select("video_id", "track", "embedding").groupBy("video_id").applyInArrow(of_video, f"video_id {kinds['video_id']}, track {kinds['track']}, face_id long")


class CentreTracks:
    """JOIN-20: each box goes to the track whose last centre is nearest, within half the box's width, else begins one. Holds one centre for each track."""

    def __init__(self):
        self.centres, self.n = np.zeros((16, 2)), 0

    def frame(self, _, boxes: np.ndarray) -> list[int]:
        out = []
        for x, y, w, h in boxes:
            centre = (x + w / 2, y + h / 2)
            far = np.hypot(*(self.centres[: self.n] - centre).T)
            own = int(far.argmin()) if self.n else 0
            if not self.n or far[own] >= w / 2:
                own = self.n
                self.n += 1
                if own == len(self.centres):
                    self.centres = np.concatenate([self.centres, np.zeros_like(self.centres)])
            self.centres[own] = centre
            out.append(own)
        return out


def _iou(box: np.ndarray, other: np.ndarray) -> float:
    side = np.maximum(np.minimum(box[2:], other[2:]) - np.maximum(box[:2], other[:2]), 0)
    shared = side.prod()
    whole = (box[2:] - box[:2]).prod() + (other[2:] - other[:2]).prod() - shared
    return shared / (whole or 1.0)


class OverlapTracks:
    """JOIN-19: in order of their beginning, tracks take of each frame's free boxes those that overlap their last one; a box that is left begins a track.

    A track takes no box right after one that it took of the same frame; that one is free for the next track. Holds the last box of each track
    that can still go on, `gap` frames at most after it.
    """

    def __init__(self, least: float, gap: int):
        self.least, self.gap, self.n, self.open = least, gap, 0, []

    def frame(self, frame: int, boxes: np.ndarray) -> list[int]:
        free, out = list(range(len(boxes))), [-1] * len(boxes)
        self.open = [t for t in self.open if frame - t["frame"] <= self.gap]
        for track in self.open:
            self._take(track, frame, boxes, free, out)
        while free:
            self.open.append({"track": self.n, "frame": frame, "box": None})
            self.n += 1
            self._take(self.open[-1], frame, boxes, free, out)
        return out

    def _take(self, track: dict, frame: int, boxes: np.ndarray, free: list[int], out: list[int]) -> None:
        k = 0
        while k < len(free):
            box = boxes[free[k]]
            if track["box"] is None or _iou(box, track["box"]) > self.least:
                out[free[k]] = track["track"]
                track.update(box=box, frame=frame)
                del free[k]
            k += 1  # the box after a taken one is passed over


def _frame_by_frame(boxes: DataFrame, corners: tuple[str, ...], make) -> DataFrame:
    """boxes with track: each video's frames in order through make()'s tracker. Rows stream through a task sorted, so it holds a batch and a tracker whatever the video's length."""
    kinds = dict(boxes.dtypes)
    keys = ["video_id", "frame", "box"]
    ordered = boxes.select(*keys, *[F.col(c).cast("double") for c in corners]).repartition("video_id").sortWithinPartitions(*keys)

    def run(batches):
        tracker, video, held = None, None, []  # held: the rows of a frame that may go on in the next batch

        def tracked(rows: pa.RecordBatch):
            nonlocal tracker, video
            v, f = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            at = np.column_stack([rows.column(k).to_numpy() for k in range(3, 3 + len(corners))])
            edges = [i for i in range(len(v)) if i == 0 or v[i] != v[i - 1] or f[i] != f[i - 1]]
            out = []
            for lo, hi in zip(edges, [*edges[1:], len(v)], strict=True):
                if tracker is None or v[lo] != video:
                    tracker, video = make(), v[lo]
                out += tracker.frame(f[lo], at[lo:hi])
            return pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(out, pa.int64())], names=[*keys, "track"])

        for b in batches:
            if not b.num_rows:
                continue
            whole = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
            last = (whole.column(0)[-1], whole.column(1)[-1])
            end = whole.num_rows
            while end and (whole.column(0)[end - 1], whole.column(1)[end - 1]) == last:
                end -= 1
            held = [whole.slice(end)]
            if end:
                yield tracked(whole.slice(0, end))
        if held:
            yield tracked(held[0])

    return ordered.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", track long")


def centre_tracks(boxes: DataFrame) -> DataFrame:
    """JOIN-20: boxes (video_id, frame, box, x, y, w, h) to tracks; see CentreTracks."""
    return _frame_by_frame(boxes, ("x", "y", "w", "h"), CentreTracks)


def overlap_tracks(boxes: DataFrame, *, least: float = TRACK_IOU, gap: int = TRACK_GAP) -> DataFrame:
    """JOIN-19: boxes (video_id, frame, box, x1, y1, x2, y2) to tracks; see OverlapTracks."""
    return _frame_by_frame(boxes, ("x1", "y1", "x2", "y2"), lambda: OverlapTracks(least, gap))


def filled_tracks(boxes: DataFrame, *, frames: int = TRACK_FRAMES, size: float = TRACK_SIZE) -> DataFrame:
    """WIN-22: tracks of more than `frames` boxes (video_id, track, frame, x1, y1, x2, y2) with a row for every frame, boxes in between by straight
    lines; only those whose mean width or height is over `size`. The earliest of several boxes of a frame counts. All in the JVM."""
    corners = ("x1", "y1", "x2", "y2")
    order = Window.partitionBy("video_id", "track").orderBy("frame")
    one = boxes.groupBy("video_id", "track", "frame").agg(F.min(F.struct(*corners)).alias("b"), F.count("*").alias("n")).select("video_id", "track", "frame", "n", "b.*")
    t = one.withColumns({"seen": F.sum("n").over(Window.partitionBy("video_id", "track")), "to": F.coalesce(F.lead("frame").over(order), F.col("frame") + 1), **{f"_{c}": F.coalesce(F.lead(c).over(order), c) for c in corners}})
    t = t.filter(F.col("seen") > frames).withColumn("at", F.explode(F.sequence("frame", F.col("to") - 1)))
    part = (F.col("at") - F.col("frame")) / (F.col("to") - F.col("frame"))
    t = t.select("video_id", "track", F.col("at").alias("frame"), *[(F.col(c) + (F.col(f"_{c}") - F.col(c)) * part).alias(c) for c in corners])
    whole = Window.partitionBy("video_id", "track")
    big = F.greatest(F.avg(F.col("x2") - F.col("x1")).over(whole), F.avg(F.col("y2") - F.col("y1")).over(whole)) > size
    return t.withColumn("big", big).filter("big").drop("big")


def median_13(values: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """WIN-22: of each row the median of the 13 values around it; beyond the edges there are zeros."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-6, 6)
    near = F.collect_list(F.col(value).cast("double")).over(w)
    padded = F.array_sort(F.concat(near, F.array_repeat(F.lit(0.0), 13 - F.size(near))))
    return values.withColumn("median", F.get(padded, F.lit(6)))


#: Fixed values of the lip-motion gates.
LIP_WIDTH, LIP_FRAMES, LIP_MOTION, LIP_OPEN = 70, 4, 0.022, 0.13


def speaking_tracks(openings: DataFrame) -> DataFrame:
    """AGG-20: of each clip the track (clip, track, frame, width, opening) whose lips move most, with its most open frame: median width and number of
    measured frames high enough, spread (of the population) and greatest opening above their gates. opening is null where it wasn't measured.

    Spreads are summed as whole billionths, so that equal ones are equal whatever the order of rows, and the smaller track counts; openings over 100
    (no lips have them) are left to doubles."""
    unit = F.when(F.abs("opening") <= 100, F.round(F.col("opening") * 1e9).cast("bigint")).cast("decimal(19,0)")
    t = openings.withColumn("x", unit).groupBy("clip", "track").agg(
        F.median("width").alias("width"), F.count("opening").alias("n"), F.count("x").alias("fit"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"),
        F.stddev_pop("opening").alias("motion"), F.max_by("frame", F.struct("opening", -F.col("frame"))).alias("frame"), F.max("opening").alias("open"),
    )
    n = F.col("n").cast("decimal(19,0)")
    exact = F.sqrt(((n * F.col("q") - F.col("s") * F.col("s")) / (n * n)).cast("double")) * 1e-9
    t = t.withColumn("motion", F.when((F.col("n") > 0) & (F.col("fit") == F.col("n")), exact).otherwise(F.col("motion")))
    best = t.filter((F.col("width") >= LIP_WIDTH) & (F.col("n") >= LIP_FRAMES)).groupBy("clip").agg(F.max_by(F.struct("track", "motion", "frame", "open"), F.struct("motion", -F.col("track"))).alias("b"))
    return best.select("clip", "b.*").filter((F.col("motion") >= LIP_MOTION) & (F.col("open") >= LIP_OPEN))


def mean_scores(scores: DataFrame) -> DataFrame:
    """AGG-21: of each frame (track, frame, scale, score) the mean over the scales, to one place, halves to even."""
    return scores.groupBy("track", "frame").agg((F.rint(F.avg("score") * 10) / 10).alias("score"))
