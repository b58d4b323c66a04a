import json

import pytest

from turnloom.sources import artifacts, sinks


def test_json_documents(spark, tmp_path):
    (tmp_path / "V1").mkdir()
    words = [{"start": 0.0, "end": 0.5, "word": "a"}, {"word": "lost"}, {"start": 0.5, "end": 0.9, "word": "b", "more": 1}]
    (tmp_path / "V1" / "asr.json").write_text("﻿" + json.dumps({"text": "a b", "segments": [{"id": 7, "start": 0, "end": 1, "words": words}]}))
    (tmp_path / "V1" / "diarization.json").write_text(json.dumps({"alignment_turns": [], "speaker_turns": [{"index": 0, "speaker": "S2", "start": 0.5, "end": 2.0}]}, indent=1))
    got = artifacts.word_rows(artifacts.read_documents(spark, "asr", f"{tmp_path}/*/asr.json")).collect()
    assert [(r.video_id, r.asr_segment_id, r.word_index, r.word) for r in got] == [("V1", 7, 0, "a"), ("V1", 7, 2, "b")]
    turns = artifacts.turn_rows(artifacts.read_documents(spark, "diarization", f"{tmp_path}/*/diarization.json")).collect()
    assert [(r.speaker, r.reconcile_cov) for r in turns] == [("S2", None)]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("v", 0, 60005, 61250, "S2", True, None)], "video_id string, pos long, start_ms long, end_ms long, speaker string, flag boolean, none string")
    sinks.write_rttm(t, f"{tmp_path}/r")
    assert spark.read.text(f"{tmp_path}/r").first()[0] == "SPEAKER v 1 60.005 1.245 <NA> <NA> S2 <NA> <NA>"
    sinks.write_table_csv(t.select("speaker", "flag").coalesce(1), f"{tmp_path}/c")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/c").collect()] == ["speaker,flag", "S2,True"]
    assert t.select(sinks.json_document(["speaker", "none"])).first()[0] == '{"speaker":"S2","none":null}'


def test_documents_of_a_library(spark, tmp_path):
    for name, style in (("V1", '{"position": "top_center"}'), ("V2", "{not json"), ("V3", '{"position": "middle"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "caption_style.json").write_text(style)
        (tmp_path / name / "speaker_map.json").write_text('{"S0": "Ada"}')
    got = {r.video_id: r.position for r in artifacts.styles(artifacts.read_kind(spark, str(tmp_path), "style")).collect()}
    assert got == {"V1": "top_center", "V2": "bottom_center", "V3": "bottom_center"}
    assert {r.video_id: r.bare for r in artifacts.read_bare_maps(spark, f"{tmp_path}/*/speaker_map.json").collect()} == {v: {"S0": "Ada"} for v in ("V1", "V2", "V3")}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        artifacts.read_kind(spark, str(tmp_path), "emotion")


def test_normalised_recognition(spark):
    rows = [("v", None, " a b ", [(1, 0.0, 1.0, " a ", [(0.0, 0.5, " a", None), (0.5, 1.0, " b", 0.5)]), (2, 1.0, 2.0, None, None)])]
    asr = spark.createDataFrame(rows, "video_id string, " + artifacts.SCHEMAS["asr"])
    r = artifacts.normalised(asr).first()
    assert (r.text, r.num_segments, r.num_words, r.segments[0].text, r.segments[1].words) == ("a b", 2, 2, "a", [])


def test_log_rows_append(spark, tmp_path):
    e = spark.createDataFrame([("p", "V1", "open", {"S0": "Ada"}, None, None), (None, "V1", "save", None, "top_center", "x")], "pid string, artifact_id string, event string, names map<string,string>, position string, video_link string")
    for _ in range(2):
        sinks.append_log(e, f"{tmp_path}/log")
    got = spark.read.json(f"{tmp_path}/log")
    assert got.count() == 4 and {(r.pid, r.names, r.position) for r in got.collect()} == {("p", '{"S0":"Ada"}', ""), ("", "{}", "top_center")}


def test_library_listing_of_pages_with_one_address(spark, tmp_path):
    import duckdb

    from turnloom.plans import catalog

    rows = [(0, "http://a/x?p=1", "ae ß"), (1, "http://a/x?p=1", "ae"), (2, "http://a/y", "ae"), (3, "http://b/y", "ae é"), (4, "http://a/", "ae")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.queries()["src11_library_listing"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.sql(catalog.oracle_sql()["src11_library_listing"])
    assert sorted(map(repr, (tuple(r[k] for k in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
