"""Folders of a library: documents, catalog, and runs that go on where an earlier one stopped."""

import json
import os

import pytest
from pyspark.sql import functions as F

from turnloom.operators import chains
from turnloom.sources import artifacts, store

MANY = 10


def test_documents_equal_the_json_library(spark, tmp_path):
    rows = [(f"v {i}é", i, None, [("a\n\"ü", 1.5), (None, 1e10)], {"k": "日本"}) for i in range(MANY)]
    df = spark.createDataFrame(rows, "video_id string, n long, none string, list array<struct<text:string, x:double>>, map map<string,string>")
    n = store.write_documents(store.pretty(df, ["n", "none", "list", "map"]).select("video_id", F.lit("meta.json").alias("file"), "body"), str(tmp_path))
    assert n == MANY
    for video, n, none, list_, map_ in rows:
        want = {"n": n, "none": none, "list": [{"text": t, "x": x} for t, x in list_], "map": map_}
        assert (tmp_path / video / "meta.json").read_bytes().decode() == json.dumps(want, indent=2, ensure_ascii=False)
    assert sorted(os.listdir(tmp_path / store.STAGING)) == []


def test_documents_are_replaced_whole_or_not_at_all(spark, tmp_path):
    doc = lambda body, video="a": spark.createDataFrame([(video, "x.srt", body)], "video_id string, file string, body string")
    store.write_documents(doc("1\nold\n"), str(tmp_path), ending="\n")
    store.write_documents(doc("1\nnew\n"), str(tmp_path), ending="\n")
    assert (tmp_path / "a/x.srt").read_text() == "1\nnew\n"
    for bad in (doc("without"), doc("x\n", "../up"), doc("x\n", ".."), doc("x\n", None)):
        with pytest.raises(Exception, match="ending|no name of a folder"):
            store.write_documents(bad, str(tmp_path), ending="\n")
    assert (tmp_path / "a/x.srt").read_text() == "1\nnew\n" and sorted(os.listdir(tmp_path)) == [store.STAGING, "a"]
    (tmp_path / store.STAGING / "killed").mkdir()
    store.clear_unfinished(spark, str(tmp_path))
    assert os.listdir(tmp_path) == ["a"]


def test_files_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    # small bodies once came together in one task, which then wrote every file
    docs = spark.range(60).select(F.concat(F.lit("v"), "id").alias("video_id"), F.lit("x.srt").alias("file"), F.concat(F.spark_partition_id().cast("string"), F.lit("\n")).alias("body"))
    done = {}
    write = type(docs.write).text
    monkeypatch.setattr(type(docs.write), "text", lambda self, path, *a, **b: done.update(n=self._df.rdd.glom().map(len).filter(lambda n: n > 0).count()) or write(self, path, *a, **b))
    assert store.write_documents(docs.coalesce(1), str(tmp_path), ending="\n") == 60
    assert done["n"] > 4 and len(os.listdir(tmp_path)) == 61


def test_a_folder_of_the_system_gets_the_files_alone(spark, tmp_path):
    # Hadoop once made each file with a checksum beside it and a chmod for both, which took a library most of its time
    docs = lambda body: spark.createDataFrame([(f"v {i}é", "x.srt", body) for i in range(MANY)], "video_id string, file string, body string")
    (tmp_path / "v 0é").mkdir()
    (tmp_path / "v 0é/.x.srt.crc").write_bytes(b"crc\0\0\0\2\0wrong")  # of a file that Hadoop wrote before
    assert store.write_documents(docs("1\nä\r\n"), str(tmp_path), ending="\n") == MANY
    assert all(os.listdir(tmp_path / f"v {i}é") == ["x.srt"] for i in range(MANY)) and os.listdir(tmp_path / store.STAGING) == []
    assert {r.value for r in spark.read.text(f"{tmp_path}/v*/x.srt", wholetext=True).collect()} == {"1\nä\r\n"}


@pytest.mark.parametrize("top", ["file://{}", "viewfs://library{}"])
def test_files_of_videos_are_looked_up(spark, tmp_path, monkeypatch, top):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.library.link.{tmp_path}", f"file://{tmp_path}")
    root = top.format(tmp_path)
    monkeypatch.setattr(store, "HELD", 5)  # texts are handed on a few at a time
    videos = spark.range(MANY).withColumnRenamed("id", "video_id").withColumn("more", F.col("video_id") * 2)
    assert store.with_file(videos, root, "x.srt").count() == store.with_file(videos, root, "x.srt", text="said").count() == 0
    docs = videos.filter("video_id % 3 = 0").select("video_id", F.lit("x.srt").alias("file"), F.concat(F.lit("é\r\n"), "video_id", F.lit("\n")).alias("body"))
    assert store.write_documents(docs, root, ending="\n") == 4
    assert sorted(map(tuple, store.with_file(videos, root, "x.srt").collect())) == [(0, 0), (3, 6), (6, 12), (9, 18)]
    assert sorted(map(tuple, store.with_file(videos, root, "x.srt", text="said").collect())) == [(v, 2 * v, f"é\r\n{v}\n") for v in (0, 3, 6, 9)]
    assert store.with_file(videos, root).count() == 0


@pytest.mark.parametrize("top", ["file://{}", "viewfs://indented{}"])
def test_documents_are_indented_where_they_are_written(spark, tmp_path, monkeypatch, top):
    # once the indented texts were shuffled and sorted, and came to the workers in Arrow batches of 64 MB, which took an executor over 3000 MB
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.indented.link.{tmp_path}", f"file://{tmp_path}")
    docs = spark.range(MANY).select(F.col("id").alias("video_id"), F.array(F.struct(F.lit('ü"\n').alias("text"), F.lit(None).cast("string").alias("none"), F.lit(1e10).alias("x"))).alias("list"), F.array().cast("array<int>").alias("empty"))
    seen = []
    write = type(docs.write).text
    monkeypatch.setattr(type(docs.write), "text", lambda self, path, *a, **b: seen.append([spark.conf.get(k) for k in store.BATCH]) or write(self, path, *a, **b))
    before = [spark.conf.get(k, None) for k in store.BATCH]
    assert store.write_documents(store.compact(docs, ["list", "empty"]).withColumn("file", F.lit("meta.json")), top.format(tmp_path), indent=True) == MANY
    assert seen == [[str(x) for x in store.BATCH.values()]] and before == [spark.conf.get(k, None) for k in store.BATCH]
    want = json.dumps({"list": [{"text": 'ü"\n', "none": None, "x": 1e10}], "empty": []}, indent=2, ensure_ascii=False)
    assert [(tmp_path / f"{v}/meta.json").read_bytes().decode() for v in range(MANY)] == [want] * MANY
    assert {r.body for r in store.pretty(docs, ["list", "empty"]).collect()} == {want}


def test_catalog_of_folders(spark, tmp_path):
    for folder, files in {"a": ("meta.json", "asr.json", "other.json"), "train/b": ("meta.json",), "train/c.d": ("asr.json", "meta.json"), "_writing/x": ("meta.json",)}.items():
        (tmp_path / folder).mkdir(parents=True)
        for f in files:
            (tmp_path / folder / f).write_text(json.dumps({"video_id": folder, "title": "T", "language": "en", "segments": []}))
    found = store.catalog(spark, str(tmp_path))
    assert sorted((r.split or "", r.video_id, r.kind) for r in found.collect()) == [("", "a", "asr"), ("", "a", "meta"), ("train", "b", "meta"), ("train", "c.d", "asr"), ("train", "c.d", "meta")]
    assert [(r.video_id, r.missing) for r in store.missing(found, ["meta", "asr"]).collect()] == [("b", ["asr"])]
    assert [r.video_id for r in store.read_all(spark, str(tmp_path), "meta").collect()] == ["a"]
    assert sorted(r.video_id for r in store.read_all(spark, str(tmp_path), "meta", split="train").collect()) == ["b", "c.d"]
    with pytest.raises(FileNotFoundError, match="speaker_map.json"):
        store.read_all(spark, str(tmp_path), "speaker_map")


def test_bare_maps_of_several_lines(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/map.json").write_text(json.dumps({"S0": "Ada", "S1": "Ü"}, indent=2, ensure_ascii=False))
    assert [(r.video_id, r.bare) for r in artifacts.read_bare_maps(spark, f"{tmp_path}/*/map.json").collect()] == [("v", {"S0": "Ada", "S1": "Ü"})]


def test_a_library_goes_on_where_it_stopped(spark, tmp_path):
    root = str(tmp_path)
    turns = spark.createDataFrame([(v, k, "AB"[k], 2000 * k, 2000 * k + 2000) for v in (1, 2, 4) for k in range(2)], "video_id long, pos long, speaker string, start_ms long, end_ms long")
    words = spark.createDataFrame([(v, k // 3, k % 3, 600 * k, 600 * k + 500, w) for v in (1, 2, 3) for k, w in enumerate([" One", " two", " three.", " Four", " five", " six."])], "video_id long, asr_segment_id long, word_index long, start_ms long, end_ms long, word string")
    media = spark.createDataFrame([(v, f"videos/{v}.mp4") for v in (1, 2, 3, 4)], "video_id long, source_video string")
    state = lambda rows: {r.video_id: (r.status, r.error) for r in rows.collect()}
    first = state(chains.prepare_library(words, turns, media.filter("video_id <> 2"), root))
    assert first == {1: ("ready", None), 3: ("failed", "no turns"), 4: ("failed", "no words")}
    files = {"aligned_segments_final.json", "captions.srt", "emotion_segments.json", "final_caption_data.json", "meta.json", "ready.json", "speaker_table.json"}
    assert set(f for f in os.listdir(tmp_path / "1") if not f.startswith(".")) == files and not (tmp_path / "3").exists()
    assert json.loads((tmp_path / "1/ready.json").read_text())["status"] == "ready" and "One two three." in (tmp_path / "1/captions.srt").read_text()
    before = (tmp_path / "1/meta.json").stat().st_mtime_ns
    (tmp_path / "2").mkdir()
    (tmp_path / "2/meta.json").write_text("half")  # a run that was killed: documents, but no marker
    second = state(chains.prepare_library(words, turns, media, root))
    assert second == {1: ("skipped", None), 2: ("ready", None), 3: ("failed", "no turns"), 4: ("failed", "no words")}
    assert (tmp_path / "1/meta.json").stat().st_mtime_ns == before and json.loads((tmp_path / "2/meta.json").read_text())["source_video"] == "videos/2.mp4"
    again = state(chains.prepare_library(words, turns, media.filter("video_id < 3"), root))
    assert set(again.values()) == {("skipped", None)}
    assert state(chains.prepare_library(words, turns, media.filter("video_id = 1"), root, overwrite=True)) == {1: ("ready", None)}


def test_a_video_where_nobody_is_known_has_all_its_documents(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "A", 0, 2000)], "video_id long, pos long, speaker string, start_ms long, end_ms long")
    words = spark.createDataFrame([(1, 0, 0, 100000, 100500, " Far.")], "video_id long, asr_segment_id long, word_index long, start_ms long, end_ms long, word string")
    media = spark.createDataFrame([(1, "videos/1.mp4")], "video_id long, source_video string")
    assert [(r.video_id, r.status) for r in chains.prepare_library(words, turns, media, str(tmp_path)).collect()] == [(1, "ready")]
    assert json.loads((tmp_path / "1/speaker_table.json").read_text()) == {"speakers": []}
    assert json.loads((tmp_path / "1/aligned_segments_final.json").read_text())["segments"][0]["speaker"] == "UNKNOWN"
