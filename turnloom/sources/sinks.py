"""Text outputs: SRT, ASS, RTTM, CSV and JSON as columns, and their writers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import ass_escaped, ass_time, drawtext_xy, font_size, place_alignment, plain_lines, seconds3, srt_time


def rttm_line() -> Column:
    """SNK-02 from columns video_id, start_ms, end_ms, speaker."""
    return F.concat_ws(" ", F.lit("SPEAKER"), F.col("video_id").cast("string"), F.lit("1"), seconds3(F.col("start_ms")), seconds3(F.col("end_ms") - F.col("start_ms")), F.lit("<NA>"), F.lit("<NA>"), F.col("speaker"), F.lit("<NA>"), F.lit("<NA>"))


def write_rttm(turns: DataFrame, path: str) -> None:
    turns.select(rttm_line().alias("value")).write.text(path)


def srt(cues: DataFrame) -> DataFrame:
    """SNK-04: one SRT document for each video, from columns video_id, pos, start_ms, end_ms, caption."""
    block = F.concat((F.col("pos") + 1).cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), F.col("caption"), F.lit("\n"))
    return cues.groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", block.alias("block")))), lambda x: x["block"]), "\n").alias("srt"))


#: SNK-05. Fixed values of the script's head.
ASS_HEAD = (
    "[Script Info]\nScriptType: v4.00+\nPlayResX: %d\nPlayResY: %d\nWrapStyle: 0\nScaledBorderAndShadow: yes\n\n[V4+ Styles]\n"
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
    "Style: Default,Malgun Gothic,%d,&H00FFFFFF,&H000000FF,&H00000000,&H64000000,0,0,0,0,100,100,0,0,1,2,1,%d,40,40,45,1\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
)
ASS_WHITE = "{\\c&HFFFFFF&}"


def ass_dialogue() -> Column:
    """SNK-05: a Dialogue line, its text in white, from columns start_ms, end_ms, caption."""
    return F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), F.lit(ASS_WHITE), ass_escaped(F.col("caption")))


def ass_head(width: Column, height: Column, place: Column) -> Column:
    return F.format_string(ASS_HEAD, width, height, font_size(height), place_alignment(place))


def ass(cues: DataFrame) -> DataFrame:
    """SNK-05: one script for each video, from columns video_id, pos, start_ms, end_ms, caption, width, height, place."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", ass_dialogue().alias("line")))), lambda x: x["line"])
    head = F.first(ass_head(F.col("width"), F.col("height"), F.col("place")))
    return cues.groupBy("video_id").agg(F.concat(F.array_join(F.concat(F.array(head), lines), "\n"), F.lit("\n")).alias("ass"))


#: SNK-06. Fixed values of the filter's options.
DRAWTEXT_OPTIONS = ":fontcolor=white:fontsize=28:line_spacing=6:box=1:boxcolor=black@0.68:boxborderw=10:x="


def drawtext_filter(file: Column, place: Column) -> Column:
    """SNK-06: the filter that shows a caption's file from start_ms to end_ms, at least 50 ms."""
    start = F.greatest(F.lit(0), F.col("start_ms"))
    x, y = drawtext_xy(place)
    return F.concat(
        F.lit("drawtext=textfile="), file, F.lit(DRAWTEXT_OPTIONS), x, F.lit(":y="), y,
        F.lit(":enable='between(t,"), seconds3(start), F.lit(","), seconds3(F.greatest(start + 50, F.col("end_ms"))), F.lit(")'"),
    )


def drawtext(cues: DataFrame) -> DataFrame:
    """SNK-06, FN-06: of each cue (video_id, pos from 0, start_ms, end_ms, caption, place) its file's name and wrapped text, and its filter."""
    from turnloom.operators.sequential import wrapped

    file = F.format_string("_drawtext_captions/caption_%04d.txt", F.col("pos"))
    return cues.select("video_id", "pos", file.alias("file"), plain_lines(wrapped(F.col("caption"))).alias("text"), drawtext_filter(file, F.col("place")).alias("filter"))


def filter_graph(files: DataFrame) -> DataFrame:
    """SNK-06: drawtext()'s filters of a video as one graph."""
    return files.groupBy("video_id").agg(F.concat(F.lit("[0:v]"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "filter"))), lambda x: x["filter"]), ","), F.lit("[v]")).alias("graph"))


def concat_list(entries: DataFrame) -> DataFrame:
    """SNK-07: a timeline (intervals.timeline_entries) as a list of pictures and durations; the last picture stands twice, as its duration counts only then."""
    file = F.when(F.col("pos").isNull(), F.lit("_gap.png")).otherwise(F.format_string("caption_%04d.png", F.col("pos")))
    g = entries.select("video_id", F.struct("entry", file.alias("file"), seconds3(F.col("duration_ms")).alias("sec")).alias("e")).groupBy("video_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    lines = F.flatten(F.transform("e", lambda e: F.array(F.concat(F.lit("file '"), e["file"], F.lit("'")), F.concat(F.lit("duration "), e["sec"]))))
    last = F.concat(F.lit("file '"), F.element_at("e", -1)["file"], F.lit("'\n"))
    return g.select("video_id", F.array_join(F.concat(F.array(F.lit("ffconcat version 1.0")), lines, F.array(last)), "\n").alias("list"))


#: SNK-09. What a finished video has.
REQUIRED = ("meta.json", "speaker_table.json", "emotion_segments.json")


def ready_markers(media: DataFrame) -> DataFrame:
    """SNK-09: a marker for each video of media(video_id, source_video), as JSON; write it after everything else."""
    return media.select("video_id", F.to_json(F.struct("video_id", "source_video", F.array(*map(F.lit, REQUIRED)).alias("required_files"), F.lit("ready").alias("status")), {"ignoreNullFields": "false"}).alias("marker"))


def log_rows(events: DataFrame) -> DataFrame:
    """SNK-11, FN-25: events(pid, artifact_id, event, names map, position, video_link) as log rows with the time, absent values as empty text."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    names = F.to_json(F.coalesce("names", F.create_map().cast("map<string,string>"))).alias("names")
    return events.select(now.alias("ts"), empty("pid"), "artifact_id", "event", names, empty("position"), empty("video_link"))


def append_log(events: DataFrame, path: str) -> None:
    """SNK-11."""
    log_rows(events).write.mode("append").json(path)


def write_table_csv(rows: DataFrame, path: str) -> None:
    """SNK-03: header, booleans as True and False."""
    flags = {c: F.initcap(F.col(c).cast("string")) for c, t in rows.dtypes if t == "boolean"}
    rows.withColumns(flags).write.option("header", True).csv(path)


def json_document(columns: list[str]) -> Column:
    """SNK-01: nulls are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
