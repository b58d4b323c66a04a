"""Corpus cleaning in five stages, each one of the operators of turnloom.llm.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of documents. Between two stages the documents are written and read again.
"""

from pyspark.sql import functions as F

from turnloom.llm import bpe, decontamination, simhash, suffix_dedup, toxicity
from turnloom.llm._store import discard_since, mark, sized, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs):
    """docs with __row, a hash of all columns: rows share it if they are equal in whole. A doc_id may be null or used again."""
    return docs.withColumn("__row", F.xxhash64(*[x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]))


def drop_toxic(spark, docs, sf_dir):
    """Documents predicted toxic go; labels of the held-out fold aren't learnt from. Each row goes or stays for its own text."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    docs = keyed(docs)
    toxic = written(toxicity.score(docs, labels, keep=["__row"]).filter("predicted = 1").select("__row").distinct(), "toxic-rows")
    return docs.join(sized(toxic), "__row", "left_anti").select(COLUMNS)


def one_of_near_copies(spark, docs, sf_dir):
    """Of each group of near copies the row of the smallest doc_id stays (of several such rows that of the smallest hash); rows that repeat it whole go."""
    docs = keyed(docs)
    found = simhash.near_duplicates(docs, keep=["__row"])
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    first = written(found.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.count_distinct("__row").alias("rows")).select("first.__row", (F.col("n") > F.col("rows")).alias("repeated")), "first-rows")
    kept = docs.join(sized(first.select("__row")), "__row", "left_semi")
    return (kept if first.filter("repeated").isEmpty() else kept.dropDuplicates(["__row"])).select(COLUMNS)


def cut_repeated_passages(spark, docs, sf_dir):
    """Later copies of passages of 100 bytes and more are cut from the texts; documents stay, even empty."""
    cut = suffix_dedup.deduplicated_text(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    docs = keyed(docs)
    leaks = written(decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), id_col="__row").select("__row").distinct(), "leak-rows")
    return docs.join(sized(leaks), "__row", "left_anti").select(COLUMNS)


def encode(spark, docs, sf_dir):
    """doc_id, number of tokens, and digests of the ids and of what they decode to."""
    return bpe.digests(docs, keep=["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]
#: The language models, fingerprints and the latent space have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = mark() - (name != STAGES[0][0])  # the documents that the stage reads go too, once its own are written
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard_since(spark, since, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
