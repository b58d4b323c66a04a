"""Cases in which an operator once did less than the whole job."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnloom.llm import decontamination, sharding, simhash, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"


def _hashes(words):
    raw = " ".join(words).encode()
    return toxicity._tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))


def test_toxicity_counts_each_word_for_itself(spark):
    n = 150_000  # more than the 2^17 cells that words once shared
    texts = [(" ".join(f"w{i:06d}" for i in range(k, n, 30)), k % 2) for k in range(30)]
    counts = toxicity.class_counts(spark.createDataFrame(texts, "text string, label int")).filter(f"what = {toxicity.WORDS}")
    assert counts.count() == n and counts.filter("ordinary + toxic <> 1").isEmpty()


def test_toxicity_continuation_counts_are_exact(spark):
    texts = [" ".join(f"w{i} target targets" for i in range(k, 3000, 3)) for k in range(3)] + ["target w1 target"] * 500 + [None, ""]
    words, stems, _, _ = _hashes(["target", "targets", "absent"])
    words = np.sort(words)
    got = toxicity.context_counts(spark.createDataFrame([(t,) for t in texts], "text string"), words, np.unique(stems))
    pairs = {(a, b) for t in texts if t for w in [re.findall(r"\w+", t)] for a, b in zip(["", *w], w, strict=False)}
    want = Counter(b for _, b in pairs)
    by_hash = dict(zip(_hashes(["target", "targets", "absent"])[0].tolist(), [want["target"], want["targets"], 0], strict=True))
    assert got[0].tolist() == [by_hash[x] for x in words.tolist()]
    in_stem = Counter(b for _, b in {(a, b[:5]) for a, b in pairs})
    assert sorted(got[1].tolist()) == sorted([in_stem["targe"], 0]) and got[2] == sum(in_stem.values())
    assert want["target"] > 3000  # nearly 90 filled the former map of 64 bits


def test_toxicity_evidence_is_the_plain_difference():
    h, s, before, _ = _hashes(["bad", "good"])
    order = np.argsort(h)
    split = {("bad", 0): 1, ("bad", 1): 40, ("good", 0): 40, ("good", 1): 1}
    own = [np.array([split[("bad", "good")[k], label] for k in order], float) for label in (0, 1)]
    none = np.zeros(0, np.uint64)
    stems = np.unique(s)
    model = toxicity.Model({toxicity.WORDS: (h[order], none, own), toxicity.STEMS: (none, none, [np.zeros(0)] * 2), toxicity.PAIRS: (none, none, [np.zeros(0)] * 2)}, (100, 100), h[order], np.array([5.0, 5.0]), s[order], stems, np.array([5.0, 5.0]), 100, [np.zeros(0)] * 2)
    raw = b"good bad good"
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    ratios = model.ratios(*toxicity._tokens(data, offsets)[:3])
    assert ratios[0] < 0 < ratios[1] and abs(model.evidence(data, offsets)[0, 0] - ratios.mean()) < 1e-12


SHARED = "x y z " * 40
ROWS = [  # without an id, or of one id, with different texts
    (None, "first " + " ".join(f"a{i}" for i in range(90))), (None, "second " + " ".join(f"b{i}" for i in range(90))), (None, SHARED + "one"), (None, SHARED + "another ending, longer"),
    (7, "third " + " ".join(f"c{i}" for i in range(90))), (7, "fourth " + " ".join(f"d{i}" for i in range(90))), (7, "fourth " + " ".join(f"d{i}" for i in range(90))),
]


@pytest.fixture(scope="module")
def shared_ids(spark):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")


def _texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_copies_of_rows_that_share_an_id(spark, shared_ids):
    once = [r for r in dict.fromkeys(ROWS) if not r[1].startswith("x y")]
    got = _texts(corpus_pipeline.one_of_near_copies(spark, shared_ids, SF))
    assert all(got[r] == 1 for r in once) and sum(got.values()) - len(once) in (1, 2)


def test_passages_are_cut_by_row(spark, shared_ids, tmp_path):
    got = _texts(suffix_dedup.deduplicated_text(shared_ids))
    whole = [r for r in ROWS if not r[1].startswith("x y")]
    assert all(got[r] == ROWS.count(r) for r in whole) and sum(got.values()) == len(ROWS)
    ends = sorted(t for _, t in got if t and t.endswith(("one", "longer")))
    assert len(ends) == 2 and min(map(len, ends)) < 100  # the later one lost what both hold
    shared_ids.write.parquet(str(tmp_path / "documents.parquet"))
    sha = Counter(r.kept_sha256 for r in suffix_dedup.op9_suffix_dedup(spark, str(tmp_path)).collect())
    assert sha == Counter(hashlib.sha256(t.encode()).hexdigest() for _, t in got.elements())


def test_toxic_rows_without_an_id_go(spark, monkeypatch, shared_ids):
    def score(docs, labels, keep):
        return docs.selectExpr("doc_id", *keep, "int(text like 'first%' or text like 'third%') predicted")

    monkeypatch.setattr(toxicity, "score", score)
    got = _texts(corpus_pipeline.drop_toxic(spark, shared_ids, SF))
    assert got == Counter(r for r in ROWS if not r[1].startswith(("first", "third")))


def test_toxicity_score_keeps_columns(spark, shared_ids):
    labels = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    assert toxicity.score(shared_ids, labels, keep=["text"]).columns == ["doc_id", "text", "score", "predicted"]


def test_leaking_rows_without_an_id_go(spark, shared_ids):
    item = pd.read_parquet(f"{SF}/benchmark.parquet").text[0]
    rows = [(None, "before it " + item + " after it"), (7, item)]
    leaking = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], shared_ids.schema)
    others = spark.read.parquet(f"{SF}/documents.parquet").select(shared_ids.columns)  # enough texts for a basis
    got = _texts(corpus_pipeline.drop_leaks(spark, shared_ids.unionByName(leaking).unionByName(others), SF))
    assert not any(r in got for r in rows) and all(got[r] >= n for r, n in Counter(ROWS).items())


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_simhash_radius(spark, radius):
    rng = random.Random(radius)
    fps = set()
    for centre in [rng.getrandbits(63) for _ in range(40)]:
        for _ in range(6):
            x = centre
            for bit in rng.sample(range(63), rng.randrange(6)):
                x ^= 1 << bit
            fps.add(x)
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius=radius)).collect()}
    least = {x: x for x in fps}
    for _ in range(12):
        least = {x: min(least[y] for y in fps if (x ^ y).bit_count() <= radius) for x in fps}
    assert {x: roots.get(x, x) for x in fps} == least


def test_simhash_settings(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert simhash.near_duplicates(docs, shingle=5).first().fp != simhash.near_duplicates(docs).first().fp
    for radius in (-1, 63, 2.5):
        with pytest.raises(ValueError):
            simhash.near_duplicates(docs, radius=radius)


def test_longest_common_subsequence_of_long_items():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (65, 128, 129, 200, 300, 40)]
    w = [f"u{k}" for k in range(128)]
    texts.append(" ".join(w))
    items = decontamination._Items(list(range(7)), texts, np.zeros(((1 << decontamination.BITS) + 1, 4), np.float32))
    for other in ([rng.choice(vocabulary) for _ in range(250)], w[64:] + w[:64]):
        raw = " ".join(other).encode()
        hashes, _ = decontamination._words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        place = np.searchsorted(items.vocabulary, hashes)
        found, _ = items.shares(np.arange(7), np.zeros(7, int), place, np.zeros(7, int), np.full(7, len(other)))
        for k, t in enumerate(texts):
            row = [0] * (len(other) + 1)
            for x in t.split():
                new = [0]
                for j, y in enumerate(other):
                    new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
                row = new
            assert round(found[k] * len(t.split())) == row[-1]


def test_shard_files_hold_every_row(spark, shared_ids, tmp_path):
    placed = sharding.histogram_shards(shared_ids, 3)
    sharding.write_shards(shared_ids, placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert _texts(back) == Counter(ROWS)
    assert Counter((r.doc_id, r.shard, r.slot) for r in back.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in placed.collect())


def test_leaks_are_found_whatever_the_ids(spark, monkeypatch):
    """The search index was once fitted on the rows that a hash of their id picked: on none of them where all ids are null or the same, and then leaks were missed."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "benchmark"))
    items = lambda rows: {r.item_id for r in decontamination.find_leaks(rows, bench).select("item_id").distinct().collect()}
    own, none = items(docs), items(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert len(own) > 100 and len(own ^ none) <= 2
