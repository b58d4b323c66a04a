"""The driver's tables as timed, labelled sequences, in integer milliseconds.

turns: conversations laid on a timeline; some have the label Unknown, a blank text or doubled spaces. words: the turns' words with
the space before them, as recognisers give them, some across a turn's border.
intervals: events as labelled intervals. The SQL of each is beside it, for the oracles.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPEAKER = "CASE WHEN (conv_id * 2 + turn * 3) % 13 = 0 THEN 'Unknown' ELSE concat('S', (conv_id + (turn + conv_id % 2) {div} 2) % 3) END"
_TEXT = "CASE WHEN (conv_id * 3 + turn) % 17 = 0 THEN '  ' WHEN (conv_id + turn) % 7 = 3 THEN replace({text}, ' ', '  ') ELSE {text} END"
_GAP = "((conv_id * 7 + turn * turn * 5 + turn * 3) % 9 - 1) * 50"
# Spread out: some gaps are wide and some turns overlap, one speaker comes back between others in every second conversation, two of three are faces,
# and in many turns a sentence ends before the last word.
_SPREAD_SPEAKER = "CASE WHEN (conv_id * 2 + turn * 3) % 13 = 0 THEN 'Unknown' ELSE CASE (conv_id + (turn + conv_id % 2) {div} 2) % (2 + conv_id % 2) WHEN 0 THEN 'FACE_0' WHEN 1 THEN CASE WHEN conv_id % 4 < 2 THEN 'FACE_1' ELSE 'S1' END ELSE 'S2' END END"
_SPREAD_TEXT = "CASE WHEN (conv_id * 3 + turn) % 17 = 0 THEN '  ' WHEN turn % 3 = 2 OR conv_id % 5 = 0 THEN regexp_replace(rtrim({text}), ' ([^ ]+)$', '. {one}') ELSE {text} END"
_SPREAD_GAP = "CASE WHEN (conv_id + turn) % 5 = 4 THEN 1800 WHEN turn % 3 = 2 THEN -120 ELSE " + _GAP + " END"


def turns(spark: SparkSession, sf_dir: str, *, spread: bool = False) -> DataFrame:
    speaker, text, gap = (_SPREAD_SPEAKER, _SPREAD_TEXT, _SPREAD_GAP) if spread else (_SPEAKER, _TEXT, _GAP)
    c = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("pos"), F.expr(speaker.format(div="div")).alias("speaker"), F.expr(text.format(text="text", one="$1")).alias("text"),
        F.expr("cast(60 * length(text) as bigint)").alias("dur"), F.expr(f"cast({gap} as bigint)").alias("gap"),
    )
    before = Window.partitionBy("video_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(before), F.lit(0))
    return c.select("video_id", "pos", "speaker", start.alias("start_ms"), (start + F.col("dur")).alias("end_ms"), "text")


def _turns_sql(speaker: str, text: str, gap: str) -> str:
    return f"""c0 AS (
  SELECT conv_id AS video_id, turn AS pos, {speaker.format(div="//")} AS speaker,
    {text.format(text="c.text", one=chr(92) + "1")} AS text, (60 * length(c.text))::BIGINT AS dur, ({gap})::BIGINT AS gap
  FROM conversations AS c
), c1 AS (
  SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM c0
), turns AS (
  SELECT video_id, pos, speaker, start_ms, start_ms + dur AS end_ms, text FROM c1
)"""


TURNS = _turns_sql(_SPEAKER, _TEXT, _GAP)
SPREAD_TURNS = _turns_sql(_SPREAD_SPEAKER, _SPREAD_TEXT, _SPREAD_GAP)


def words(spark: SparkSession, sf_dir: str, *, spread: bool = False) -> DataFrame:
    """PRJ-02: segments' words flattened with their index; blank ones dropped after indexing."""
    t = turns(spark, sf_dir, spread=spread)
    tokens = F.split("text", " ")
    w = t.withColumn("tokens", tokens).select("video_id", "pos", "start_ms", "tokens", F.posexplode("tokens").alias("word_index", "word"))
    w = w.withColumn("k", F.sum(F.length("word") + 1).over(Window.partitionBy("video_id", "pos").orderBy("word_index").rowsBetween(Window.unboundedPreceding, -1)))
    start = F.col("start_ms") + 60 * F.coalesce("k", F.lit(0)) + F.expr("((video_id + pos) % 5 - 2) * 120")
    return w.filter("word <> ''").select("video_id", F.col("pos").alias("asr_segment_id"), F.col("word_index").cast("bigint").alias("word_index"), start.cast("bigint").alias("start_ms"), (start + 60 * F.length("word")).cast("bigint").alias("end_ms"), F.expr("if(word_index % 9 = 4, word, concat(' ', word))").alias("word"))


WORDS = TURNS + """, w0 AS (
  SELECT video_id, pos, start_ms, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS word_index FROM turns
), w1 AS (
  SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY video_id, pos ORDER BY word_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM w0
), words AS (
  SELECT video_id, pos AS asr_segment_id, word_index::BIGINT AS word_index, (start_ms + 60 * k + ((video_id + pos) % 5 - 2) * 120)::BIGINT AS start_ms,
    (start_ms + 60 * k + ((video_id + pos) % 5 - 2) * 120 + 60 * length(word))::BIGINT AS end_ms, CASE WHEN word_index % 9 = 4 THEN word ELSE ' ' || word END AS word
  FROM w1 WHERE word <> ''
)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return e.select(F.col("user_id").alias("video_id"), "event_id", F.col("event_type").alias("label"), start.alias("start_ms"), (start + F.expr("cast(round(value * 100) as bigint) * 600")).alias("end_ms"))


INTERVALS = """intervals AS (
  SELECT user_id AS video_id, event_id, event_type AS label, epoch_us(ts) // 1000 AS start_ms,
    epoch_us(ts) // 1000 + round(value * 100)::BIGINT * 600 AS end_ms
  FROM events
)"""
