"""The scalar functions and picks work on the whole of what they are given."""

from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_collapsed_takes_the_whole_text(spark):
    got = {r.doc_id: r.collapsed for r in catalog.queries()["fn01_collapsed_whole_text"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") > 300).collect()}
    assert texts and all(got[i] == " ".join(t.split()) for i, t in texts.items())


#: Picks written out by hand.
EIGHT = {0: [], 5: [0, 1, 2, 3, 4], 8: [0, 1, 2, 3, 4, 5, 6, 7], 9: [0, 1, 2, 3, 4, 5, 6, 8], 15: [0, 2, 4, 6, 8, 10, 12, 14], 100: [0, 14, 28, 42, 56, 70, 84, 99]}
THIRTY = {3: [0, 1, 2], 30: [*range(30)], 31: [*range(15), *range(16, 31)], 59: [*range(0, 59, 2)], 88: [*range(0, 88, 3)]}


def test_even_places(spark):
    eight, thirty = T.even_places(F.col("id"), 8), T.even_places(F.col("id"), 30, rounded=True)
    got = {r.id: (r.eight, r.thirty) for r in spark.range(0, 101).select("id", eight.alias("eight"), thirty.alias("thirty")).collect()}
    assert {n: got[n][0] for n in EIGHT} == EIGHT and {n: got[n][1] for n in THIRTY} == THIRTY


def test_latest_of_all_segments_takes_every_conversation(spark):
    got = catalog.queries()["src05_latest_of_all_segments"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
