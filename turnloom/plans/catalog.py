"""All queries of the library proper, each with DuckDB SQL for the same rows. Names begin with the IDs of the inventory."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import intervals as I
from turnloom.operators import labels as L
from turnloom.operators import vectors as V
from turnloom.sources.adapters import INTERVALS, TURNS, WORDS, intervals, read, turns, words

_QUERIES: dict = {}
_SQL: dict = {}

_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


_CLEAN_TEXT = f"coalesce(string_agg(nullif({clean_sql('text')}, ''), ' ' ORDER BY pos), '')"


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


def _b(df, *longs):
    return df.withColumns({c: F.col(c).cast("bigint") for c in longs})


# --- summary and naming ---------------------------------------------------------------------------------------------

SUMMARY = TURNS + """, g AS (
  SELECT video_id, speaker, sum(end_ms - start_ms)::BIGINT AS total_ms, count(*) AS num_turns, max(end_ms - start_ms) AS max_turn_ms, min(pos) AS first_pos
  FROM turns WHERE upper(speaker) <> 'UNKNOWN' GROUP BY ALL
), summary AS (
  SELECT video_id, speaker, total_ms, num_turns, max_turn_ms, row_number() OVER (PARTITION BY video_id ORDER BY total_ms DESC, first_pos) AS rank,
    round(CASE WHEN sum(total_ms) OVER (PARTITION BY video_id) = 0 THEN 0 ELSE total_ms / (sum(total_ms) OVER (PARTITION BY video_id))::DOUBLE END, 6) AS share,
    round(total_ms / num_turns, 6) AS avg_turn_ms FROM g
)"""
NAMES = [("S0", "Ada"), ("S1", " "), ("S7", "Nobody")]
NAMES_SQL = "names AS (SELECT * FROM (VALUES ('S0', 'Ada'), ('S1', ' '), ('S7', 'Nobody')) AS t(speaker_id, display_name))"


def _names(spark):
    return spark.createDataFrame(NAMES, "speaker_id string, display_name string")


@query("stage05_speaker_summary", f"WITH {SUMMARY}, {NAMES_SQL} SELECT s.*, s.rank <= 8 AS selected_for_labeling, s.speaker AS speaker_id, coalesce(n.display_name, s.speaker) AS speaker_display FROM summary s LEFT JOIN names n ON n.speaker_id = s.speaker AND trim(n.display_name) <> ''")
def _(spark, d):
    return L.apply_names(L.speaker_summary(turns(spark, d)), _names(spark))


@query("agg04_known_totals", f"WITH {TURNS} SELECT video_id, coalesce(sum(end_ms - start_ms) FILTER (WHERE upper(speaker) <> 'UNKNOWN'), 0)::BIGINT AS known_ms, coalesce(sum(end_ms - start_ms) FILTER (WHERE upper(speaker) = 'UNKNOWN'), 0)::BIGINT AS unknown_ms, count(DISTINCT speaker) AS num_speakers FROM (SELECT video_id, CASE WHEN pos = 3 THEN 'Unknown' ELSE speaker END AS speaker, start_ms, end_ms FROM turns) GROUP BY video_id")
def _(spark, d):
    return L.known_totals(turns(spark, d).withColumn("speaker", F.when(F.col("pos") == 3, "Unknown").otherwise(F.col("speaker"))))


@query("agg03_segment_share_at_volume", "SELECT c_mktsegment AS speaker, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total, count(*) AS n, max(round(o_totalprice * 100)::BIGINT) AS most, round(sum(round(o_totalprice * 100)::BIGINT) / (sum(sum(round(o_totalprice * 100)::BIGINT)) OVER ())::DOUBLE, 6) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def _(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    j = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("speaker")).agg(F.sum(cents).alias("total"), F.count("*").alias("n"), F.max(cents).alias("most"))
    return j.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(1))), 6))


@query("sort04_top_k_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, cents, rn FROM (SELECT l_suppkey, l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(l_extendedprice * 100)::BIGINT DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def _(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents")
    t = read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", cents)
    return t.withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("cents"), "l_orderkey", "l_linenumber")).cast("bigint")).filter("rn <= 3")


@query("join07_update_names", f"WITH {TURNS}, {NAMES_SQL} SELECT video_id, pos, speaker AS speaker_id, coalesce(n.display_name, speaker) AS speaker_display FROM turns LEFT JOIN names n ON n.speaker_id = speaker")
def _(spark, d):
    return L.update_names(turns(spark, d).select("video_id", "pos", F.col("speaker").alias("speaker_id"), F.col("speaker").alias("speaker_display")), _names(spark))


def _labels(spark, d):
    return turns(spark, d).select(F.when(F.expr("pos % 3 = 0"), F.concat(F.lit("FACE_"), F.col("video_id") % 12)).when(F.expr("pos % 3 = 1"), F.concat(F.lit("AUDIO_"), F.col("pos"))).otherwise(F.col("speaker")).alias("label"))


_LABELS = TURNS + ", labelled AS (SELECT CASE WHEN pos % 3 = 0 THEN 'FACE_' || (video_id % 12) WHEN pos % 3 = 1 THEN 'AUDIO_' || pos ELSE speaker END AS label FROM turns)"


@query("stage11_naming_rows", f"WITH {_LABELS}, w AS (SELECT DISTINCT label AS speaker FROM labelled WHERE label LIKE 'FACE\\_%' ESCAPE '\\' OR label LIKE 'AUDIO\\_%' ESCAPE '\\'), tab AS (SELECT * FROM (VALUES ('FACE_1', 10), ('AUDIO_4', 20), ('S1', 30)) AS t(speaker, total_ms)) SELECT speaker, total_ms::BIGINT AS total_ms, CASE WHEN speaker LIKE 'FACE%' THEN 0 ELSE 1 END AS sort_kind, coalesce(try_cast(nullif(regexp_replace(speaker, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS sort_no FROM w LEFT JOIN tab USING (speaker)")
def _(spark, d):
    return L.naming_rows(spark.createDataFrame([("FACE_1", 10), ("AUDIO_4", 20), ("S1", 30)], "speaker string, total_ms long"), _labels(spark, d))


_VERSIONS = "versions AS (SELECT conv_id AS video_id, CASE turn % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'corrected' WHEN 2 THEN 'gap_corrected' WHEN 3 THEN 'final' ELSE 'other' END AS version, min(turn) AS turn FROM conversations GROUP BY ALL)"


@query("src05_latest_segments", f"WITH {_VERSIONS} SELECT video_id, version, turn FROM versions QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY CASE version WHEN 'final' THEN 1 WHEN 'gap_corrected' THEN 2 WHEN 'corrected' THEN 3 WHEN 'raw' THEN 4 ELSE 5 END, version) = 1")
def _(spark, d):
    kind = F.expr("case turn % 5 when 0 then 'raw' when 1 then 'corrected' when 2 then 'gap_corrected' when 3 then 'final' else 'other' end")
    v = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("video_id"), kind.alias("version")).agg(F.min("turn").alias("turn"))
    return L.latest(v, ["final", "gap_corrected", "corrected", "raw"], ["video_id"])


_ALL_VERSIONS = "versions AS (SELECT conv_id AS video_id, CASE turn % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'corrected' WHEN 2 THEN 'gap_corrected' WHEN 3 THEN 'final' ELSE 'other' END AS version, min(turn) AS turn FROM conversations GROUP BY ALL)"


# short conversations have no later versions
@query("src05_latest_of_all_segments", f"WITH {_ALL_VERSIONS} SELECT video_id, version, turn FROM versions QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY CASE version WHEN 'final' THEN 1 WHEN 'gap_corrected' THEN 2 WHEN 'corrected' THEN 3 WHEN 'raw' THEN 4 ELSE 5 END, version) = 1")
def _(spark, d):
    kind = F.expr("case turn % 5 when 0 then 'raw' when 1 then 'corrected' when 2 then 'gap_corrected' when 3 then 'final' else 'other' end")
    v = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("video_id"), kind.alias("version")).agg(F.min("turn").alias("turn"))
    return L.latest(v, ["final", "gap_corrected", "corrected", "raw"], ["video_id"])


# --- alignment ------------------------------------------------------------------------------------------------------

CANDIDATES = WORDS + """, cand AS (
  SELECT w.video_id, w.asr_segment_id, w.word_index, t.speaker, sum(least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms))::BIGINT AS overlap_ms,
    sum(least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms)) / any_value(w.end_ms - w.start_ms) AS coverage, min(t.pos) AS first_pos, arg_min(t.start_ms, t.pos) AS turn_start_ms, arg_min(t.end_ms, t.pos) AS turn_end_ms
  FROM words w JOIN turns t ON w.video_id = t.video_id AND least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms) > 0 GROUP BY ALL
), top AS (
  SELECT video_id, asr_segment_id, word_index, speaker, overlap_ms, coverage, overlap_ms - second AS overlap_margin_ms, coalesce(overlap_ms - second <= 50, false) AS boundary_ambiguous, candidates
  FROM (SELECT *, row_number() OVER w AS rn, lead(overlap_ms) OVER w AS second, string_agg(speaker || ':' || overlap_ms, ',') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS candidates
    FROM cand WINDOW w AS (PARTITION BY video_id, asr_segment_id, word_index ORDER BY overlap_ms DESC, first_pos)) WHERE rn = 1
)"""
ASSIGNED = CANDIDATES + """, rest AS (
  SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.video_id = w.video_id AND top.asr_segment_id = w.asr_segment_id AND top.word_index = w.word_index)
), near AS (
  SELECT w.video_id, w.asr_segment_id, w.word_index, t.speaker, greatest(t.start_ms - w.end_ms, w.start_ms - t.end_ms, 0) AS nearest_gap_ms
  FROM rest w JOIN turns t USING (video_id) WHERE greatest(t.start_ms - w.end_ms, w.start_ms - t.end_ms, 0) <= 3000
  QUALIFY row_number() OVER (PARTITION BY w.video_id, w.asr_segment_id, w.word_index ORDER BY greatest(t.start_ms - w.end_ms, w.start_ms - t.end_ms, 0), abs(w.start_ms + w.end_ms - t.start_ms - t.end_ms), t.pos) = 1
), assigned AS (
  SELECT w.*, coalesce(top.speaker, near.speaker, 'UNKNOWN') AS speaker, CASE WHEN top.speaker IS NOT NULL THEN 'overlap' WHEN near.speaker IS NOT NULL THEN 'nearest' ELSE 'unknown' END AS matched_by,
    coalesce(overlap_ms, 0) AS overlap_ms, coalesce(coverage, 0) AS coverage, overlap_margin_ms, coalesce(boundary_ambiguous, false) AS boundary_ambiguous, nearest_gap_ms::BIGINT AS nearest_gap_ms, coalesce(candidates, '') AS candidates
  FROM words w LEFT JOIN top USING (video_id, asr_segment_id, word_index) LEFT JOIN near USING (video_id, asr_segment_id, word_index)
)"""
_SHOWN = "* REPLACE (round(coverage, 6) AS coverage)"


def _shown(df):
    """Coverage to six places, candidates as text."""
    out = df.withColumn("coverage", F.round("coverage", 6)).drop("reconcile_source", "reconcile_cov")
    if "candidates" in df.columns:
        out = out.withColumn("candidates", F.array_join(F.transform("candidates", lambda c: F.concat(c["speaker"], F.lit(":"), c["overlap_ms"])), ","))
    return out


@query("prj02_words", f"WITH {WORDS} SELECT * FROM words")
def _(spark, d):
    return words(spark, d)


@query("join01_overlap_candidates", f"WITH {CANDIDATES} SELECT {_SHOWN} FROM cand")
def _(spark, d):
    return _shown(I.candidates(words(spark, d), turns(spark, d)))


@query("join02_dominant_speaker", f"WITH {CANDIDATES} SELECT {_SHOWN} FROM top")
def _(spark, d):
    return _shown(I.dominant(words(spark, d), turns(spark, d)))


@query("join04_assign_speakers", f"WITH {ASSIGNED} SELECT {_SHOWN} FROM assigned")
def _(spark, d):
    return _shown(I.assign(words(spark, d), turns(spark, d)))


SEGMENTS = ASSIGNED + f""", f AS (
  SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND asr_segment_id = lag(asr_segment_id) OVER w AND start_ms - lag(end_ms) OVER w <= 500 THEN 0 ELSE 1 END AS new
  FROM assigned WINDOW w AS (PARTITION BY video_id ORDER BY asr_segment_id, word_index)
), i AS (
  SELECT *, (sum(new) OVER (PARTITION BY video_id ORDER BY asr_segment_id, word_index) - 1)::BIGINT AS index FROM f
), segments AS (
  SELECT video_id, index, arg_min(start_ms, asr_segment_id * 100000 + word_index) AS start_ms, arg_max(end_ms, asr_segment_id * 100000 + word_index) AS end_ms, any_value(speaker) AS speaker,
    'word_alignment' AS source, {strip_sql("string_agg(word, '' ORDER BY asr_segment_id, word_index)")} AS text, count(*) AS num_words, sum(overlap_ms)::BIGINT AS overlap_ms, round(avg(coverage), 6) AS coverage, bool_or(boundary_ambiguous) AS boundary_ambiguous,
    string_agg(DISTINCT matched_by, ',' ORDER BY matched_by) AS match_methods, array_to_string(list_sort(list(DISTINCT asr_segment_id)), ',') AS asr_segment_ids
  FROM i GROUP BY video_id, index
)"""


def flat_segments(s):
    """Segments with lists as text and without the words."""
    return s.drop("words").withColumns({"coverage": F.round("coverage", 6), "match_methods": F.array_join("match_methods", ","), "asr_segment_ids": F.array_join(F.col("asr_segment_ids").cast("array<string>"), ",")})


@query("stage01_align", f"WITH {SEGMENTS} SELECT *, greatest(end_ms - start_ms, 0) AS duration_ms FROM segments")
def _(spark, d):
    return flat_segments(I.segments(I.assign(words(spark, d), turns(spark, d))))


# --- islands --------------------------------------------------------------------------------------------------------

RUNS = TURNS + f""", r0 AS (
  SELECT *, sum(CASE WHEN speaker = ls THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY pos) AS stretch FROM (SELECT *, lag(speaker) OVER (PARTITION BY video_id ORDER BY pos) AS ls FROM turns)
), r1 AS (
  SELECT *, max(end_ms) OVER (PARTITION BY video_id, stretch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r0
), r2 AS (
  SELECT *, (sum(CASE WHEN start_ms - reach <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY pos) - 1)::BIGINT AS run_index FROM r1
), runs AS (
  SELECT video_id, run_index, min(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, sum(greatest(end_ms - start_ms, 0))::BIGINT AS speech_ms, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS num_segments, {_CLEAN_TEXT} AS text
  FROM r2 GROUP BY video_id, run_index
)"""


def _runs(spark, d):
    return I.runs(turns(spark, d), merge_gap_ms=200)


@query("win02_speaker_runs", f"WITH {RUNS} SELECT * FROM runs")
def _(spark, d):
    return _runs(spark, d)


@query("win03_interval_packing", f"WITH {INTERVALS}, a AS (SELECT *, max(end_ms) OVER (PARTITION BY video_id, label ORDER BY start_ms, end_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals), b AS (SELECT *, (sum(CASE WHEN start_ms > reach + 3600000 OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, label ORDER BY start_ms, end_ms, event_id) - 1)::BIGINT AS island FROM a) SELECT video_id, label, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM b GROUP BY ALL")
def _(spark, d):
    return I.pack(intervals(spark, d), ["video_id", "label"], gap_ms=3_600_000)


GLUED = TURNS + """, g0 AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY pos) AS gap_ms FROM turns
), glued AS (SELECT *, (sum(CASE WHEN gap_ms >= -50 AND gap_ms < 100 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY pos) - 1)::BIGINT AS span FROM g0)"""


@query("win04_glued_spans", f"WITH {GLUED} SELECT video_id, pos, gap_ms, span FROM glued")
def _(spark, d):
    return I.glued_spans(turns(spark, d)).select("video_id", "pos", "gap_ms", "span")


@query("win05_remerge_glued", f"WITH {GLUED}, m AS (SELECT *, (sum(CASE WHEN speaker = ls AND gap_ms BETWEEN -50 AND 100 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY pos) - 1)::BIGINT AS index FROM (SELECT *, lag(speaker) OVER (PARTITION BY video_id ORDER BY pos) AS ls FROM glued)) SELECT video_id, index, min(speaker) AS speaker, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms, count(*) AS merged, CASE WHEN count(*) = 1 THEN any_value(text) ELSE {_CLEAN_TEXT} END AS text FROM m GROUP BY video_id, index")
def _(spark, d):
    return I.remerge_glued(turns(spark, d))


BOUNDARY = GLUED + """, n AS (
  SELECT *, lag(speaker) OVER w AS ls, lag(span) OVER w AS lsp, lead(gap_ms) OVER w AS after, lead(speaker) OVER w AS nx FROM glued WINDOW w AS (PARTITION BY video_id ORDER BY pos)
), b AS (
  SELECT video_id, span, min(pos) AS lo, max(pos) AS hi, coalesce(sum((speaker <> ls AND span = lsp)::INT), 0) AS changes, arg_min(coalesce(gap_ms, 300), pos) AS b, arg_max(coalesce(after, 300), pos) AS a,
    arg_min(speaker, pos) AS left_label, arg_max(speaker, pos) AS right_label, arg_min(coalesce(ls, ''), pos) AS left_anchor, arg_max(coalesce(nx, ''), pos) AS right_anchor FROM n GROUP BY video_id, span
), boundary AS (
  SELECT video_id, lo, hi, left_label, right_label,
    CASE WHEN len(list_distinct(list_filter([left_anchor, right_anchor], lambda x: x IN (left_label, right_label)))) = 1 THEN list_filter([left_anchor, right_anchor], lambda x: x IN (left_label, right_label))[1] END AS target_speaker
  FROM b WHERE changes = 1 AND b >= 300 AND a >= 300
)"""


def _boundary(spark, d):
    t = turns(spark, d)
    return L.anchor_target(L.boundary_candidates(I.glued_spans(t)), t)


@query("win06_boundary_candidates", f"WITH {BOUNDARY} SELECT * FROM boundary")
def _(spark, d):
    return _boundary(spark, d).select("video_id", "lo", "hi", "left_label", "right_label", "target_speaker")


@query("stage03_boundary_repair", f"WITH {BOUNDARY} SELECT t.video_id, t.pos, coalesce(b.target_speaker, t.speaker) AS speaker, CASE WHEN b.target_speaker <> t.speaker THEN t.speaker END AS speaker_original, EXISTS (SELECT 1 FROM boundary c WHERE c.video_id = t.video_id AND t.pos BETWEEN c.lo AND c.hi) AS checked FROM turns t LEFT JOIN boundary b ON t.video_id = b.video_id AND t.pos BETWEEN b.lo AND b.hi AND b.target_speaker IS NOT NULL AND (b.video_id + b.lo) % 2 = 0")
def _(spark, d):
    judged = _boundary(spark, d).withColumn("approved", F.expr("(video_id + lo) % 2 = 0"))
    return L.repair_boundaries(turns(spark, d), judged).select("video_id", "pos", "speaker", "speaker_original", "checked")


CANDIDATE_RUNS = RUNS + """, cr AS (
  SELECT *, lag(speaker) OVER w AS left_speaker, lead(speaker) OVER w AS right_speaker, count(*) OVER (PARTITION BY video_id) AS n, lead(text) OVER w AS next_text, lead(start_ms) OVER w - end_ms AS gap_ms,
    coalesce(lag(speech_ms) OVER w, lead(speech_ms) OVER w) AS other_ms, coalesce(lag(num_segments) OVER w, lead(num_segments) OVER w) AS other_n
  FROM runs WINDOW w AS (PARTITION BY video_id ORDER BY run_index)
), candidates AS (
  SELECT * FROM cr WHERE (coalesce(left_speaker <> speaker, false) OR coalesce(right_speaker <> speaker, false)) AND CASE
    WHEN n <> 2 THEN text <> '' AND speech_ms <= 60000 AND left_speaker IS NOT NULL AND right_speaker IS NOT NULL
    WHEN num_segments < other_n AND speech_ms <= 60000 THEN true WHEN num_segments > other_n AND other_ms <= 60000 THEN false ELSE speech_ms <= 60000 AND speech_ms < other_ms END
)"""
PROPOSALS = CANDIDATE_RUNS + """, borders AS (
  SELECT video_id, run_index, speaker <> right_speaker AND gap_ms <= 1500 AND gap_ms >= -50 AND text <> '' AND next_text <> '' AND (video_id + run_index) % 2 = 0 AS same FROM cr WHERE right_speaker IS NOT NULL
), pr AS (
  SELECT c.video_id, c.run_index, c.speaker AS from_speaker, c.left_speaker, c.right_speaker, coalesce(l.same, false) AS ls, coalesce(r.same, false) AS rs
  FROM candidates c LEFT JOIN borders l ON l.video_id = c.video_id AND l.run_index + 1 = c.run_index LEFT JOIN borders r ON r.video_id = c.video_id AND r.run_index = c.run_index
), proposals AS (
  SELECT * FROM (SELECT video_id, run_index, from_speaker,
    CASE WHEN ls AND rs THEN CASE WHEN left_speaker = right_speaker THEN 'both_agree' ELSE 'both_conflict' END WHEN ls THEN 'left' WHEN rs THEN 'right' ELSE 'none' END AS resolution,
    CASE WHEN ls AND rs THEN CASE WHEN left_speaker = right_speaker THEN left_speaker END WHEN ls THEN left_speaker WHEN rs THEN right_speaker END AS to_speaker FROM pr) WHERE to_speaker <> from_speaker
)"""


@query("win09_candidate_runs", f"WITH {CANDIDATE_RUNS} SELECT video_id, run_index, speaker, left_speaker, right_speaker, speech_ms FROM candidates")
def _(spark, d):
    return L.run_candidates(_runs(spark, d), max_ms=60_000).select("video_id", "run_index", "speaker", "left_speaker", "right_speaker", "speech_ms")


@query("prj20_border_eligibility", f"WITH {CANDIDATE_RUNS} SELECT video_id, run_index, gap_ms, CASE WHEN speaker = right_speaker THEN 'same_label' WHEN gap_ms > 1500 THEN 'gap_too_large' WHEN gap_ms < -50 THEN 'overlap' WHEN text = '' OR next_text = '' THEN 'empty_text' END AS reason, NOT (speaker = right_speaker OR gap_ms > 1500 OR gap_ms < -50 OR text = '' OR next_text = '') AS eligible FROM cr WHERE right_speaker IS NOT NULL")
def _(spark, d):
    return L.eligibility(_runs(spark, d))


def _proposals(spark, d):
    borders = L.eligibility(_runs(spark, d)).select("video_id", "run_index", F.expr("eligible and (video_id + run_index) % 2 = 0").alias("same"))
    return L.proposals(L.run_candidates(_runs(spark, d), max_ms=60_000), borders)


@query("prj21_proposals", f"WITH {PROPOSALS} SELECT * FROM proposals")
def _(spark, d):
    return _proposals(spark, d).drop("anchors")


@query("join14_conflicts", f"WITH {PROPOSALS}, an AS (SELECT video_id, run_index, to_speaker, unnest(CASE resolution WHEN 'both_agree' THEN [run_index - 1, run_index + 1] WHEN 'left' THEN [run_index - 1] ELSE [run_index + 1] END) AS anchor FROM proposals), hit AS (SELECT an.video_id, an.run_index, an.anchor FROM an JOIN proposals q ON q.video_id = an.video_id AND q.run_index = an.anchor AND q.to_speaker <> an.to_speaker) SELECT video_id, run_index FROM hit UNION SELECT video_id, anchor FROM hit")
def _(spark, d):
    return L.conflicts(_proposals(spark, d))


# --- reconciliation -------------------------------------------------------------------------------------------------

FACES = "faces AS (SELECT conv_id AS video_id, (conv_id + turn) % 4 AS face_id, (turn * 2500 + conv_id % 7 * 300)::BIGINT AS start_ms, (turn * 2500 + conv_id % 7 * 300 + length(text) * 30)::BIGINT AS end_ms FROM conversations)"


def _faces(spark, d):
    c = read(spark, d, "conversations")
    start = F.expr("cast(turn * 2500 + conv_id % 7 * 300 as bigint)")
    return c.select(F.col("conv_id").alias("video_id"), F.expr("(conv_id + turn) % 4").alias("face_id"), start.alias("start_ms"), (start + F.length("text") * 30).alias("end_ms"))


RECONCILED = TURNS + ", " + FACES + """, fo AS (
  SELECT t.video_id, t.pos, t.speaker, t.end_ms - t.start_ms AS dur, f.face_id, sum(least(t.end_ms, f.end_ms) - greatest(t.start_ms, f.start_ms))::BIGINT AS o, min(f.start_ms) AS seen
  FROM turns t JOIN faces f ON t.video_id = f.video_id AND least(t.end_ms, f.end_ms) - greatest(t.start_ms, f.start_ms) > 0 GROUP BY ALL
), fr AS (
  SELECT *, row_number() OVER w AS rn, coalesce(lead(o) OVER w, 0) AS second FROM fo WINDOW w AS (PARTITION BY video_id, pos ORDER BY o DESC, seen, face_id)
), direct AS (
  SELECT video_id, pos, face_id, round(o / dur, 3) AS cov, round((o - second) / dur, 3) AS margin FROM fr WHERE rn = 1 AND 100 * o >= 20 * dur AND 100 * (o - second) >= 15 * dur AND o >= 120
), tot AS (SELECT video_id, speaker, sum(end_ms - start_ms)::BIGINT AS total FROM turns GROUP BY ALL
), mx AS (SELECT video_id, speaker, face_id, sum(o)::BIGINT AS o, min(pos * 100 + rn) AS first FROM fr GROUP BY ALL
), tp AS (
  SELECT *, row_number() OVER w AS k, coalesce(lead(o) OVER w, 0) AS o2 FROM mx WINDOW w AS (PARTITION BY video_id, speaker ORDER BY o DESC, first)
), fd AS (SELECT t.video_id, t.speaker, count(DISTINCT face_id) AS n, min(face_id) AS f FROM turns t JOIN direct USING (video_id, pos) GROUP BY ALL
), back AS (
  SELECT tp.video_id, tp.speaker, tp.face_id AS back_face FROM tp JOIN tot USING (video_id, speaker) LEFT JOIN fd USING (video_id, speaker)
  WHERE k = 1 AND 100 * o >= 65 * total AND 100 * (o - o2) >= 25 * total AND total >= 2000 AND (fd.n IS NULL OR fd.n = 1 AND fd.f = tp.face_id)
), reconciled AS (
  SELECT t.video_id, t.pos, t.speaker AS speaker_audio, coalesce('FACE_' || coalesce(face_id, back_face), t.speaker) AS speaker,
    CASE WHEN face_id IS NOT NULL THEN 'visual' WHEN back_face IS NOT NULL THEN 'visual_global' ELSE 'audio' END AS reconcile_source, cov, margin, t.start_ms, t.end_ms
  FROM turns t LEFT JOIN direct USING (video_id, pos) LEFT JOIN back ON back.video_id = t.video_id AND back.speaker = t.speaker
)"""


@query("stage02_reconcile", f"WITH {RECONCILED} SELECT * FROM reconciled")
def _(spark, d):
    return L.reconcile(turns(spark, d), _faces(spark, d))


@query("agg09_reconcile_audit", f"WITH {RECONCILED}, a AS (SELECT video_id, round(sum(CASE WHEN reconcile_source = 'visual' THEN end_ms - start_ms ELSE 0 END) / sum(end_ms - start_ms), 3) AS onscreen_coverage, round(sum(CASE WHEN reconcile_source = 'visual_global' THEN end_ms - start_ms ELSE 0 END) / sum(end_ms - start_ms), 3) AS global_backfill_coverage FROM reconciled GROUP BY 1), m AS (SELECT video_id, count(*) FILTER (WHERE n >= 2) AS n_merges_fixed FROM (SELECT video_id, speaker, count(DISTINCT speaker_audio) AS n FROM reconciled WHERE reconcile_source <> 'audio' GROUP BY ALL) GROUP BY 1), s AS (SELECT video_id, count(*) FILTER (WHERE n >= 2) AS n_splits_fixed FROM (SELECT video_id, speaker_audio, count(DISTINCT speaker) AS n FROM reconciled WHERE reconcile_source <> 'audio' GROUP BY ALL) GROUP BY 1) SELECT a.*, coalesce(n_merges_fixed, 0) AS n_merges_fixed, coalesce(n_splits_fixed, 0) AS n_splits_fixed FROM a LEFT JOIN m USING (video_id) LEFT JOIN s USING (video_id)")
def _(spark, d):
    return L.reconcile_audit(L.reconcile(turns(spark, d), _faces(spark, d)))


# --- captions and text ----------------------------------------------------------------------------------------------


TIMELINE = TURNS + """, totals AS (
  SELECT video_id, CASE video_id % 3 WHEN 0 THEN 0 WHEN 1 THEN max(end_ms) + 700 ELSE max(end_ms) - 300 END AS total_ms FROM turns GROUP BY video_id
), o0 AS (
  SELECT video_id, pos, greatest(start_ms, 0) AS start_ms, greatest(end_ms, start_ms + 50) AS end_ms, total_ms FROM turns JOIN totals USING (video_id)
), o AS (
  SELECT * REPLACE (CASE WHEN total_ms > 0 THEN total_ms ELSE last_value(end_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS total_ms), lead(start_ms) OVER w AS after, row_number() OVER w AS i
  FROM o0 WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, end_ms, pos)
), h AS (
  SELECT *, greatest(CASE WHEN coalesce(after, total_ms) > start_ms THEN least(greatest(end_ms, start_ms + 1200), coalesce(after, total_ms)) ELSE greatest(end_ms, start_ms + 1200) END, start_ms + 50) AS held_ms FROM o
), t AS (
  SELECT *, (max(greatest(held_ms, start_ms + 50) - 50 * i) OVER (PARTITION BY video_id ORDER BY i) + 50 * i)::BIGINT AS until_ms FROM h
), l AS (
  SELECT *, coalesce(lag(until_ms) OVER (PARTITION BY video_id ORDER BY i), 0) AS before FROM t
), shown AS (
  SELECT video_id, pos, held_ms, greatest(start_ms, before)::BIGINT AS shown_ms, until_ms, CASE WHEN start_ms - before > 1 THEN start_ms - before ELSE 0 END::BIGINT AS gap_ms,
    CASE WHEN after IS NULL AND total_ms - until_ms > 1 THEN total_ms - until_ms ELSE 0 END::BIGINT AS tail_ms FROM l
), entries AS (
  SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY shown_ms, cue, k) - 1 AS entry, pos, duration_ms FROM (
    SELECT video_id, shown_ms, pos AS cue, 0 AS k, NULL AS pos, gap_ms AS duration_ms FROM shown UNION ALL SELECT video_id, shown_ms, pos, 1, pos, until_ms - shown_ms FROM shown UNION ALL SELECT video_id, shown_ms, pos, 2, NULL, tail_ms FROM shown
  ) WHERE duration_ms > 0
)"""


def _timeline(spark, d):
    t = turns(spark, d)
    total = F.expr("case video_id % 3 when 0 then 0 when 1 then max(end_ms) + 700 else max(end_ms) - 300 end")
    return I.timeline(t, t.groupBy("video_id").agg(total.alias("total_ms")))


@query("win14_timeline", f"WITH {TIMELINE} SELECT * FROM shown")
def _(spark, d):
    return _timeline(spark, d)


_SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query("snk04_srt", f"WITH {TURNS} SELECT video_id, string_agg((pos + 1) || chr(10) || {_SRT.format('start_ms')} || ' --> ' || {_SRT.format('end_ms')} || chr(10) || '[' || speaker || '] ' || text || chr(10), chr(10) ORDER BY pos) AS srt FROM turns GROUP BY video_id")
def _(spark, d):
    from turnloom.sources.sinks import srt

    return srt(turns(spark, d).withColumn("caption", F.concat(F.lit("["), F.col("speaker"), F.lit("] "), F.col("text"))))


@query("snk02_rttm", f"WITH {TURNS} SELECT video_id, pos, 'SPEAKER ' || video_id || ' 1 ' || (start_ms // 1000) || '.' || lpad((start_ms % 1000)::VARCHAR, 3, '0') || ' ' || ((end_ms - start_ms) // 1000) || '.' || lpad(((end_ms - start_ms) % 1000)::VARCHAR, 3, '0') || ' <NA> <NA> ' || speaker || ' <NA> <NA>' AS line FROM turns")
def _(spark, d):
    from turnloom.sources.sinks import rttm_line

    return turns(spark, d).select("video_id", "pos", rttm_line().alias("line"))


@query("win16_parts", f"WITH {TURNS} SELECT video_id, pos, (row_number() OVER (PARTITION BY video_id, speaker ORDER BY pos) - 1)::BIGINT AS part, count(*) OVER (PARTITION BY video_id, speaker) AS part_count, (row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1) // 40 AS batch FROM turns")
def _(spark, d):
    w = Window.partitionBy("video_id", "speaker")
    return turns(spark, d).select("video_id", "pos", (F.row_number().over(w.orderBy("pos")) - 1).cast("bigint").alias("part"), F.count("*").over(w).alias("part_count"), F.expr("cast((row_number() over (partition by video_id order by pos) - 1) div 40 as bigint)").alias("batch"))


@query("win08_context_window", f"WITH {RUNS}, c AS (SELECT video_id, run_index AS t, count(*) OVER (PARTITION BY video_id) AS n FROM runs), s AS (SELECT video_id, t, least(3, n) AS c, greatest(0, least(t - least(3, n) // 2, n - least(3, n))) AS s FROM c) SELECT s.video_id, s.t AS run_index, string_agg(r.speaker, ',' ORDER BY r.run_index) AS context FROM s JOIN runs r ON r.video_id = s.video_id AND r.run_index >= s.s AND r.run_index < s.s + s.c GROUP BY ALL")
def _(spark, d):
    r = _runs(spark, d)
    w = Window.partitionBy("video_id").orderBy("run_index")
    # a full-width window lies within two runs of its centre, so no whole timeline is collected
    near = F.collect_list(F.struct("run_index", "speaker")).over(w.rowsBetween(-2, 2))
    t = r.select("video_id", "run_index", near.alias("near"), F.count("*").over(Window.partitionBy("video_id")).alias("n"))
    t = t.withColumn("c", F.least(F.lit(3), "n")).withColumn("s", F.expr("greatest(0, least(run_index - c div 2, n - c))"))
    return t.select("video_id", "run_index", F.expr("array_join(transform(filter(near, x -> x.run_index >= s and x.run_index < s + c), x -> x.speaker), ',')").alias("context"))


@query("fn_text_functions", r"""SELECT doc_id, trim(regexp_replace(text, '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS collapsed, nullif(substr(regexp_replace(regexp_replace(source || '-' || lang || '_', '[^A-Za-z0-9_-]', '', 'g'), '^[-_]+|[-_]+$', '', 'g'), 1, 64), '') AS clean_id, lower(lang) || '--' || source AS repo, regexp_matches(text, '[.!?…！？][\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$') AND lower(trim(text)) NOT IN ('mr.', 'mrs.', 'ms.', 'dr.', 'prof.', 'sr.', 'jr.', 'st.', 'vs.', 'etc.', 'e.g.', 'i.e.') AS ends FROM (SELECT doc_id, source, lang, replace(text, chr(10), ' ') AS text FROM documents)""")
def _(spark, d):
    t = read(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    return t.select("doc_id", T.collapsed(F.col("text")).alias("collapsed"), T.sanitised_id(F.concat_ws("", "source", F.lit("-"), "lang", F.lit("_"))).alias("clean_id"), F.replace(F.concat_ws("/", F.lower("lang"), "source"), F.lit("/"), F.lit("--")).alias("repo"), T.ends_sentence(F.col("text")).alias("ends"))


@query("fn01_collapsed_whole_text", r"SELECT doc_id, trim(regexp_replace(text, '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS collapsed FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", T.collapsed(F.col("text")).alias("collapsed"))


@query("fn27_basename", "SELECT page_id, regexp_extract(url, '[^\\\\/]+$', 0) AS base FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", T.basename(F.col("url")).alias("base"))


#: What a recogniser may give: two tags, one of another kind, none, three and a stray bracket.
TAGGED = f"""tagged AS (
  SELECT *, CASE turn % 4 WHEN 0 THEN '<|en|><|' || upper(role) || '|>' || text WHEN 1 THEN '<b> ' || text WHEN 2 THEN text ELSE '<|en|><|SAD|><x>> ' || text END AS raw FROM conversations
), parsed AS (
  SELECT *, coalesce(tags[2], tags[1], '|EMO_UNKNOWN|') AS emotion, CASE WHEN starts_with(said, '>') THEN {strip_sql("said[2:]")} ELSE said END AS transcript
  FROM (SELECT *, regexp_extract_all(raw, '<([^<>]+)>', 1) AS tags, {strip_sql("regexp_replace(raw, '<[^<>]+>', '', 'g')")} AS said FROM tagged)
)"""
RAW = "case turn % 4 when 0 then concat('<|en|><|', upper(role), '|>', text) when 1 then concat('<b> ', text) when 2 then text else concat('<|en|><|SAD|><x>> ', text) end"


@query("prj10_parsed_tags", f"WITH {TAGGED} SELECT conv_id, turn, emotion, transcript FROM parsed")
def _(spark, d):
    emotion, transcript = T.parsed_tags(F.expr(RAW))
    return read(spark, d, "conversations").select("conv_id", "turn", emotion.alias("emotion"), transcript.alias("transcript"))


@query("prj12_display_prefix", f"WITH {TURNS} SELECT video_id, pos, CASE WHEN speaker = 'S0' THEN 'Ada' END AS prefix FROM turns")
def _(spark, d):
    name = F.when(F.col("speaker") == "S0", " Ada ").when(F.col("speaker") == "S1", "unknown").otherwise(F.col("speaker"))
    return turns(spark, d).select("video_id", "pos", T.display_prefix(F.col("speaker"), name).alias("prefix"))


@query("fn03_ass_time", "SELECT event_id, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS ass FROM (SELECT event_id, round_even(event_id * 7919 / 10, 0)::BIGINT AS cs FROM events)")
def _(spark, d):
    return read(spark, d, "events").select("event_id", T.ass_time(F.col("event_id") * 7919).alias("ass"))


_HEX = "CASE p_partkey % 3 WHEN 0 THEN '#' || printf('%06x', p_partkey * 7919 % 16777216) WHEN 1 THEN printf('%06X', p_partkey * 7919 % 16777216) ELSE '#' || printf('%04x', p_partkey % 65536) END"


@query("fn04_hex_rgb", f"SELECT p_partkey, hex, ('0x' || h[1:2])::INT || ',' || ('0x' || h[3:4])::INT || ',' || ('0x' || h[5:6])::INT AS rgb, upper('&H' || h[5:6] || h[3:4] || h[1:2]) AS ass, '0x' || upper(h) AS drawtext FROM (SELECT *, CASE WHEN length(ltrim(hex, '#')) = 6 THEN ltrim(hex, '#') ELSE 'FFFFFF' END AS h FROM (SELECT p_partkey, {_HEX} AS hex FROM part))")
def _(spark, d):
    n = F.expr("p_partkey * 7919 % 16777216")
    hex_ = F.when(F.expr("p_partkey % 3 = 0"), F.format_string("#%06x", n)).when(F.expr("p_partkey % 3 = 1"), F.format_string("%06X", n)).otherwise(F.format_string("#%04x", F.expr("p_partkey % 65536")))
    p = read(spark, d, "part").select("p_partkey", hex_.alias("hex"))
    return p.select("p_partkey", "hex", T.hex_rgb(F.col("hex")).alias("rgb"), T.hex_ass(F.col("hex")).alias("ass"), T.hex_drawtext(F.col("hex")).alias("drawtext"))


MEANS = "means AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL), norms AS (SELECT label, sqrt(sum(m * m)) + 1e-9 AS norm, list(m ORDER BY i) AS v FROM means GROUP BY label)"


@query("fn16_agg18_mean_embedding", f"WITH {MEANS} SELECT label, i, round(m / norm * 10000)::BIGINT AS mean FROM means JOIN norms USING (label)")
def _(spark, d):
    return V.mean_vectors(read(spark, d, "embeddings"), "label").select("label", F.posexplode("mean").alias("k", "m")).select("label", (F.col("k") + 1).cast("bigint").alias("i"), F.round(F.col("m") * 10000).cast("bigint").alias("mean"))


# a track's frames: the entries of its vector that are over a twentieth
@query("agg11_representative", "WITH n AS (SELECT label, vec_id, len(list_filter(embedding, lambda c: c > 0.05)) AS n FROM embeddings) SELECT label, arg_max(vec_id, (greatest(n, 1), -vec_id)) AS best FROM n GROUP BY label HAVING sum(n) > 0")
def _(spark, d):
    return V.representative(read(spark, d, "embeddings"), "label", F.col("vec_id"), F.size(F.filter("embedding", lambda c: c > F.lit(0.05).cast("float"))))


@query("agg07_bipartite_sets", f"WITH {RECONCILED} SELECT video_id, speaker_audio, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS faces FROM reconciled WHERE reconcile_source <> 'audio' GROUP BY ALL")
def _(spark, d):
    return L.reconcile(turns(spark, d), _faces(spark, d)).filter("reconcile_source <> 'audio'").groupBy("video_id", "speaker_audio").agg(F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("faces"))


@query("join15_condition_grid", f"WITH {TURNS} SELECT video_id, pos, condition FROM turns, (VALUES ('none'), ('speaker'), ('emotion'), ('both')) AS c(condition)")
def _(spark, d):
    # four fixed conditions for each caption
    return turns(spark, d).select("video_id", "pos", F.explode(F.array(*[F.lit(c) for c in ("none", "speaker", "emotion", "both")])).alias("condition"))


@query("sort09_even_sample", "SELECT conv_id, turn FROM (SELECT conv_id, turn, count(*) OVER w AS n, row_number() OVER (w ORDER BY turn) - 1 AS i FROM conversations WINDOW w AS (PARTITION BY conv_id)) WHERE CASE WHEN n >= 8 THEN list_contains(list_transform(range(0, 8), lambda k: (k * (n - 1)) // 7), i) ELSE true END")
def _(spark, d):
    w = Window.partitionBy("conv_id")
    t = read(spark, d, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy("turn")) - 1).cast("bigint").alias("i"))
    return t.filter(F.array_contains(T.even_places(F.col("n"), 8), F.col("i"))).select("conv_id", "turn")


@query("sort09_even_places", "SELECT o_custkey, n, CASE WHEN n >= 8 THEN list_transform(range(0, 8), lambda i: (i * (n - 1)) // 7) ELSE range(0, n) END::BIGINT[] AS eight, CASE WHEN n > 30 THEN list_transform(range(0, 30), lambda i: round_even(i * (n - 1) / 29.0, 0)::BIGINT) ELSE range(0, n) END::BIGINT[] AS thirty FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def _(spark, d):
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", "n", T.even_places(F.col("n"), 8).alias("eight"), T.even_places(F.col("n"), 30, rounded=True).alias("thirty"))


@query("set03_tag_union", f"WITH {TURNS} SELECT video_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT video_id, speaker AS tag FROM turns UNION ALL SELECT video_id, 'gap' FROM turns) GROUP BY 1")
def _(spark, d):
    return turns(spark, d).groupBy("video_id").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("speaker"), F.array(F.lit("gap")))), ",").alias("tags"))


# --- grouped pandas, without SQL ------------------------------------------------------------------------------------


def _among(text: str, characters: str) -> str:
    return f"right({text}, 1) IN ({', '.join(repr(c) for c in characters)})"


def _cues_sql() -> str:
    """WIN-19 as a recursion from cut to cut; places count from 0, lists from 1. A cue has twelve words at most, but for the last ones, so forty places are enough to find its end."""
    lasts = lambda k: f"(en[{k} + 1] - st[at + 1])"
    viable = lambda k: f"({k} + 1 = n OR (n - {k} - 1 >= 2 AND en[n] - st[{k} + 2] >= 750))"
    readable = lambda k: f"({lasts(k)} >= 750 AND {viable(k)})"
    full = f"(k + 1 < n AND ({lasts('k')} >= 3500 OR k + 1 - at >= 12))"
    border = f"coalesce(list_max(list_filter(range(at, k + 1), lambda j: {readable('j')} AND so[j + 1])) + 1, 0)"
    target = f"CASE WHEN k + 1 < n AND {readable('k')} AND se[k + 1] THEN k + 1 WHEN {full} AND {border} > 0 THEN {border} WHEN {full} AND {viable('k')} THEN k + 1 ELSE 0 END"
    short = ", ".join(f"'{x}'" for x in T.ABBREVIATIONS)
    return f"""WITH RECURSIVE {WORDS}, tok AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, asr_segment_id ORDER BY word_index) - 1 AS k, {strip_sql('word')} AS t FROM words
), wl AS (
  SELECT video_id, asr_segment_id AS parent_index, list(start_ms ORDER BY k) AS st, list(end_ms ORDER BY k) AS en, list({_among('t', T.SENTENCE_ENDS)} AND lower(t) NOT IN ({short}) ORDER BY k) AS se,
    list(({_among('t', T.SENTENCE_ENDS)} AND lower(t) NOT IN ({short})) OR {_among('t', T.SOFT_ENDS)} ORDER BY k) AS so, count(*) AS n, count(*) >= 2 AND bool_and(t <> '' AND end_ms >= start_ms) AS valid FROM tok GROUP BY ALL
), go AS (
  SELECT video_id, parent_index, 0::BIGINT AS at_, 0::BIGINT AS lo, 0::BIGINT AS part FROM wl
  UNION ALL
  SELECT video_id, parent_index, CASE WHEN valid THEN coalesce(list_filter(list_transform(range(at_, least(n, at_ + 40)), lambda k: {target}), lambda x: x > 0)[1], n) ELSE n END AS at_, at_ AS lo, part + 1 AS part FROM go JOIN wl USING (video_id, parent_index) WHERE at_ < n
), cue AS (SELECT *, max(part) OVER (PARTITION BY video_id, parent_index) AS part_count FROM go WHERE part > 0
), said AS (
  SELECT c.*, t.start_ms, t.end_ms, t.k, t.word, t.t, t.t <> '' AS filled, row_number() OVER (PARTITION BY c.video_id, c.parent_index, part, t.t <> '' ORDER BY t.k) AS nth FROM cue c JOIN tok t ON t.video_id = c.video_id AND t.asr_segment_id = c.parent_index AND t.k >= c.lo AND t.k < c.at_
) SELECT video_id, parent_index, part, part_count, arg_min(start_ms, k) AS start_ms, arg_max(end_ms, k) AS end_ms, count(*) AS num_words,
  {strip_sql("string_agg(CASE WHEN filled AND nth = 1 THEN t WHEN filled AND (regexp_matches(word, '^" + _WS + "') OR left(t, 1) IN (" + ", ".join(repr(c) for c in T.CLOSING_MARKS) + ")) THEN word WHEN filled THEN ' ' || word ELSE '' END, '' ORDER BY k)")} AS text
FROM said GROUP BY video_id, parent_index, part, part_count""".replace("st[at + 1]", "st[at_ + 1]").replace("range(at, k + 1)", "range(at_, k + 1)").replace("k + 1 - at >=", "k + 1 - at_ >=")


@query("win19_caption_cues", _cues_sql())
def _(spark, d):
    from turnloom.operators.sequential import split_cues

    return split_cues(words(spark, d).withColumnRenamed("asr_segment_id", "parent_index"))


@query("agg19_face_clusters")
def _(spark, d):
    from turnloom.operators.sequential import cluster_tracks

    # a video has a few hundred tracks; the table's vectors are dealt to as many videos as that takes
    e = read(spark, d, "embeddings").select(F.expr("vec_id div 200").alias("video_id"), F.col("vec_id").alias("track"), "embedding")
    return cluster_tracks(e)


@query("join20_centre_tracks", f"""WITH RECURSIVE {TURNS}, b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame, box) AS rn FROM (SELECT video_id, pos AS frame, box, box * 25 + pos * (video_id % 9) AS x, video_id % 50 AS y, 20 + 10 * (pos % 3) AS w FROM turns, unnest([0, 1, 2]) AS u(box))),
go AS (
  SELECT video_id, 0::BIGINT AS rn, NULL::BIGINT AS frame, NULL::INT AS box, NULL::BIGINT AS track, CAST([] AS DOUBLE[][]) AS centres FROM (SELECT DISTINCT video_id FROM b)
  UNION ALL
  SELECT video_id, rn, frame, box, own - 1 AS track, list_concat(list_concat(centres[:own - 1], [[cx, cy]]), centres[own + 1:]) AS centres
  FROM (SELECT *, CASE WHEN len(far) > 0 AND list_min(far) < w / 2 THEN list_position(far, list_min(far)) ELSE len(centres) + 1 END AS own
    FROM (SELECT b.*, go.centres, b.x + b.w / 2 AS cx, b.y + 20.0 AS cy, list_transform(go.centres, lambda c: sqrt((c[1] - b.x - b.w / 2) ** 2 + (c[2] - b.y - 20) ** 2)) AS far FROM go JOIN b ON b.video_id = go.video_id AND b.rn = go.rn + 1))
) SELECT video_id, frame, box, track FROM go WHERE rn > 0""")
def _(spark, d):
    from turnloom.operators.sequential import centre_tracks

    boxes = turns(spark, d).select("video_id", F.col("pos").alias("frame"), F.explode(F.array(*map(F.lit, range(3)))).alias("box"))
    return centre_tracks(boxes.withColumns({"x": F.expr("box * 25 + frame * (video_id % 9)"), "y": F.expr("video_id % 50"), "w": F.expr("20 + 10 * (frame % 3)"), "h": F.lit(40)}))


# --- further projections, joins and aggregates ----------------------------------------------------------------------


@query("stage10_face_intervals", f"WITH {INTERVALS}, f AS (SELECT video_id, event_id % 3 AS face_id, event_id, (start_ms // 40) * 40 AS start_ms, (start_ms // 40) * 40 + 40 AS end_ms FROM intervals), a AS (SELECT *, max(end_ms) OVER (PARTITION BY video_id, face_id ORDER BY start_ms, end_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f), b AS (SELECT *, (sum(CASE WHEN start_ms > reach + 7200000 OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, face_id ORDER BY start_ms, end_ms, event_id) - 1)::BIGINT AS island FROM a) SELECT video_id, face_id, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM b GROUP BY ALL")
def _(spark, d):
    # FN-19: a frame of 25 a second is an interval of 40 ms
    f = intervals(spark, d).select("video_id", F.expr("event_id % 3").alias("face_id"), "event_id", F.expr("(start_ms div 40) * 40").alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 40)
    return I.pack(f, ["video_id", "face_id"], gap_ms=7_200_000)


@query("prj01_normalised_text", f"WITH {TURNS} SELECT video_id, count(*) AS num_segments, sum(len(list_filter(string_split(trim(text), ' '), lambda x: x <> '')))::BIGINT AS num_words FROM turns GROUP BY video_id")
def _(spark, d):
    n = F.size(F.filter(F.split(F.trim("text"), " "), lambda w: w != ""))
    return turns(spark, d).groupBy("video_id").agg(F.count("*").alias("num_segments"), F.sum(n).alias("num_words"))


@query("prj11_padded_clips", f"WITH {TURNS} SELECT video_id, pos, greatest(start_ms + 100, end_ms + 200) AS clip_end, greatest(start_ms * 16, 0)::BIGINT AS first_sample, least(greatest(start_ms + 100, end_ms + 200) * 16, 2000000)::BIGINT AS last_sample FROM turns")
def _(spark, d):
    from turnloom.operators.captions import clip_end, sample_range

    end = clip_end(F.col("start_ms"), F.col("end_ms"))
    first, last = sample_range(F.col("start_ms"), end, F.lit(16000), F.lit(2_000_000).cast("bigint"))
    return turns(spark, d).select("video_id", "pos", end.alias("clip_end"), first.alias("first_sample"), last.alias("last_sample"))


@query("prj09_stub_emotion", f"WITH {TURNS} SELECT video_id, pos, speaker, '|EMO_UNKNOWN|' AS emotion, NULL::VARCHAR AS emotion_transcript, 'stub' AS emotion_backend FROM turns")
def _(spark, d):
    from turnloom.operators.captions import stub_emotion

    return stub_emotion(turns(spark, d).select("video_id", "pos", "speaker"))


_MARK = "CASE pos % 5 WHEN 0 THEN '😄' WHEN 1 THEN '' WHEN 2 THEN '[|LOST|]' WHEN 3 THEN '' ELSE '' END"
_TAG = "case pos % 5 when 0 then '|HAPPY|' when 1 then '|EMO_UNKNOWN|' when 2 then '|LOST|' when 3 then '|NEUTRAL|' else null end"
_BODY = strip_sql("coalesce(nullif(CASE WHEN pos % 2 = 0 THEN '' ELSE upper(speaker) END, ''), text)")
_NAME = "CASE WHEN speaker = 'S0' THEN '[Ada]' ELSE '' END"


@query("prj13_caption_text", f"WITH {TURNS} SELECT video_id, pos, {strip_sql(f'{_NAME} || {_MARK} || chr(32) || {_BODY}')} AS caption, {strip_sql(f'{_MARK} || chr(32) || {_BODY}')} AS without_name, {_BODY} AS plain FROM turns")
def _(spark, d):
    prefix = T.display_prefix(F.col("speaker"), F.when(F.col("speaker") == "S0", "Ada"))
    args = prefix, F.expr(_TAG), F.when(F.expr("pos % 2 = 0"), "").otherwise(F.upper("speaker")), F.col("text")
    return turns(spark, d).select("video_id", "pos", T.caption_text(*args).alias("caption"), T.caption_text(*args, speaker=False, hide_unknown=False).alias("without_name"), T.caption_text(*args, speaker=False, emotion=False).alias("plain"))


@query("prj15_untranslated_rows", f"WITH {TURNS} SELECT video_id, pos, false AS overwrite FROM turns WHERE trim(text) <> '' AND pos % 2 = 0 UNION ALL SELECT video_id, pos, true FROM turns WHERE trim(text) <> ''")
def _(spark, d):
    from turnloom.operators.captions import untranslated

    t = turns(spark, d).withColumn("text_ko", F.when(F.expr("pos % 2 = 1"), "x"))
    both = [untranslated(t, overwrite=o).select("video_id", "pos", F.lit(o).alias("overwrite")) for o in (False, True)]
    return both[0].union(both[1])


@query("join12_translations_back", f"WITH {TURNS} SELECT video_id, pos AS index, CASE WHEN pos % 3 = 1 THEN 'old' WHEN trim(text) <> '' AND pos % 2 = 0 THEN 'ko: ' || {strip_sql('text')} END AS text_ko FROM turns")
def _(spark, d):
    from turnloom.operators.captions import translated

    t = turns(spark, d).select("video_id", F.col("pos").alias("index"), "text", F.when(F.expr("pos % 3 = 1"), "old").alias("text_ko"))
    some = lambda rows: rows.filter("index % 2 = 0").withColumn("text_ko", F.concat(F.lit("ko: "), F.col("text")))
    return translated(t, some).select("video_id", "index", "text_ko")


@query("join11_hints_without_resolved", f"WITH {RECONCILED} SELECT DISTINCT video_id, speaker_audio FROM reconciled r WHERE reconcile_source = 'visual' AND NOT EXISTS (SELECT 1 FROM reconciled g WHERE g.video_id = r.video_id AND g.speaker_audio = r.speaker_audio AND g.reconcile_source = 'visual_global')")
def _(spark, d):
    r = L.reconcile(turns(spark, d), _faces(spark, d))
    keys = ["video_id", "speaker_audio"]
    return r.filter("reconcile_source = 'visual'").select(keys).distinct().join(r.filter("reconcile_source = 'visual_global'").select(keys), keys, "left_anti")


@query("src13_video_by_name", "SELECT page_id, 'videos/' || coalesce(nullif(regexp_extract(url, '[^\\\\/]+$', 0), ''), 'none') AS path FROM pages")
def _(spark, d):
    from turnloom.sources.artifacts import moved_path

    return read(spark, d, "pages").select("page_id", F.coalesce(moved_path(F.col("url")), F.lit("videos/none")).alias("path"))


@query("stage04_correction", f"WITH {PROPOSALS}, an AS (SELECT video_id, run_index, to_speaker, unnest(CASE resolution WHEN 'both_agree' THEN [run_index - 1, run_index + 1] WHEN 'left' THEN [run_index - 1] ELSE [run_index + 1] END) AS anchor FROM proposals), hit AS (SELECT an.video_id, an.run_index, an.anchor FROM an JOIN proposals q ON q.video_id = an.video_id AND q.run_index = an.anchor AND q.to_speaker <> an.to_speaker), bad AS (SELECT video_id, run_index FROM hit UNION SELECT video_id, anchor FROM hit), clear AS (SELECT * FROM proposals p WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.video_id = p.video_id AND bad.run_index = p.run_index)) SELECT r.video_id, r.run_index, coalesce(c.to_speaker, r.speaker) AS speaker, CASE WHEN c.to_speaker IS NOT NULL THEN r.speaker END AS speaker_original FROM runs r LEFT JOIN clear c USING (video_id, run_index)")
def _(spark, d):
    return L.correct_runs(_runs(spark, d), _proposals(spark, d)).select("video_id", "run_index", "speaker", "speaker_original")


@query("stage06_apply_names", f"WITH {TURNS}, {NAMES_SQL} SELECT t.video_id, t.pos, t.speaker AS speaker_id, coalesce(n.display_name, t.speaker) AS speaker_display FROM turns t LEFT JOIN names n ON n.speaker_id = t.speaker AND trim(n.display_name) <> ''")
def _(spark, d):
    return L.apply_names(turns(spark, d), _names(spark)).select("video_id", "pos", "speaker_id", "speaker_display")


@query("stage07_emotion", f"WITH {TAGGED} SELECT conv_id AS video_id, turn AS index, turn * 1000 AS start_ms, emotion, transcript AS emotion_transcript, raw AS emotion_raw, 'model' AS emotion_backend, greatest(turn * 1000 + 100, turn * 1000 + length(text) + 200)::BIGINT AS clip_end_ms FROM parsed")
def _(spark, d):
    from turnloom.operators.captions import read_emotion

    c = read(spark, d, "conversations")
    s = c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("index"), (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + F.length("text")).alias("end_ms"), F.expr(RAW).alias("raw"))
    return read_emotion(s, lambda rows: rows.withColumnRenamed("raw", "emotion_raw")).drop("end_ms")


_ESCAPED = r"replace(replace(translate(replace({0}, '\', '\\'), '{{}}', '()'), chr(13) || chr(10), '\N'), chr(10), '\N')"
_ASS_TIME = "printf('%d:%02d:%02d.%02d', round_even({0} / 10, 0)::BIGINT // 360000, round_even({0} / 10, 0)::BIGINT // 6000 % 60, round_even({0} / 10, 0)::BIGINT // 100 % 60, round_even({0} / 10, 0)::BIGINT % 100)"
#: A caption with everything that has to be escaped.
CAPTION = r"'{' || speaker || '}\' || chr(13) || chr(10) || text"
DIALOGUE = "'Dialogue: 0,' || " + _ASS_TIME.format("start_ms") + " || ',' || " + _ASS_TIME.format("end_ms") + " || ',Default,,0,0,0,,{\\c&HFFFFFF&}' || " + _ESCAPED.format("(" + CAPTION + ")")


def with_caption(t):
    return t.withColumn("caption", F.concat(F.lit("{"), "speaker", F.lit("}\\\r\n"), "text"))


@query("stage09_render_dialogue", f"WITH {TURNS} SELECT video_id, pos, {DIALOGUE} AS line FROM turns")
def _(spark, d):
    from turnloom.sources.sinks import ass_dialogue

    return with_caption(turns(spark, d)).select("video_id", "pos", ass_dialogue().alias("line"))


@query("agg22_stage_counters", f"WITH {PROPOSALS} SELECT (SELECT count(*) FROM runs) AS num_runs, (SELECT count(*) FROM candidates) AS num_candidates, (SELECT count(*) FROM proposals) AS num_proposals")
def _(spark, d):
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    all_ = one(_runs(spark, d), "num_runs").union(one(L.run_candidates(_runs(spark, d), max_ms=60_000), "num_candidates")).union(one(_proposals(spark, d), "num_proposals"))
    return all_.agg(*[F.max(F.when(F.col("name") == k, F.col("n"))).alias(k) for k in ("num_runs", "num_candidates", "num_proposals")])


@query("prj04_speaker_bounds", "SELECT s_suppkey, coalesce(num, lo, 1) AS lo, coalesce(num, hi, 20) AS hi FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey END AS num, CASE WHEN s_suppkey % 2 = 0 THEN 2 END AS lo, CASE WHEN s_suppkey % 5 < 2 THEN s_nationkey + 3 END AS hi FROM supplier)")
def _(spark, d):
    from turnloom.sources.artifacts import speaker_bounds

    lo, hi = speaker_bounds(F.expr("case when s_suppkey % 3 = 0 then s_nationkey end"), F.expr("case when s_suppkey % 2 = 0 then 2 end"), F.expr("case when s_suppkey % 5 < 2 then s_nationkey + 3 end"))
    return read(spark, d, "supplier").select("s_suppkey", lo.alias("lo"), hi.alias("hi"))


@query("prj05_turn_list_pick", f"WITH {TURNS} SELECT video_id, pos, speaker FROM turns t WHERE trim(text) <> '' OR NOT EXISTS (SELECT 1 FROM turns o WHERE o.video_id = t.video_id AND trim(o.text) <> '')")
def _(spark, d):
    # the first list has the turns with text; where a video has none, its second list, of all turns, is taken
    from turnloom.sources.artifacts import picked_turns

    one = F.struct("pos", "speaker")
    g = turns(spark, d).groupBy("video_id").agg(F.collect_list(F.when(F.trim("text") != "", one)).alias("a"), F.collect_list(one).alias("s"))
    return g.select("video_id", F.inline(picked_turns(F.col("a"), F.col("s"))))


@query("prj03_turn_rows", f"WITH {INTERVALS} SELECT video_id, event_id, label AS speaker, (row_number() OVER (PARTITION BY video_id ORDER BY start_ms, event_id) - 1)::BIGINT AS index, end_ms - start_ms AS duration_ms FROM intervals")
def _(spark, d):
    order = Window.partitionBy("video_id").orderBy("start_ms", "event_id")
    return intervals(spark, d).select("video_id", "event_id", F.col("label").alias("speaker"), (F.row_number().over(order) - 1).cast("bigint").alias("index"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


from turnloom.plans import more  # noqa: E402, F401  its queries register with these
