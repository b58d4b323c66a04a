"""Quality classifier with hierarchical empirical Bayes.

A logistic curve over a text's shape gives each document's own evidence. Sites say more about documents
than one text does, so evidence (of learnt documents the label) is pooled by host and by path below the host: a path's
posterior is the mean of its other documents, shrunk towards its host's, which is shrunk towards the global mean, each with a
prior strength estimated from how much the groups' means differ (method of moments). A sparse site so stays near
the global prior. A document's score puts its path's posterior in the global prior's place. Its own evidence counts once: it is
left out of its path's and its host's posterior.

Without a column of addresses the source stands for the host and source and language for the path. All is
DataFrame functions but the fit of the curve, on at most MAX_LABELLED labelled texts (of one doc_id one); every label, however many,
is pooled. Groups are summed before they are shuffled; their sums are broadcast if they are counted to be few, else joined by key, where hot ones are left to the skew join.

Defined results: a null or empty text has the shape of no words; null hosts and paths are groups of
their own; of several labels of a doc_id the best wins; null labels aren't learnt from; without labels of
both classes every score is the share of ones (1 without labels); repeated rows are scored each; an empty table
gives an empty result; other columns aren't read.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import sized, table, written
from .toxicity import _logistic

#: Labelled rows that the curve is fitted on, at most.
MAX_LABELLED = 20_000
SHAPE = ("log_words", "upper", "symbols", "digits", "bars", "distinct", "word_length", "lines")


def shape(text):
    """Measures of a text's shape, by built-in functions, as one struct. Equal parts, as the words, are evaluated once by the generated code."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    share = lambda remove: (F.length(text) - F.length(F.translate(text, remove, ""))) / chars
    n = F.greatest(F.size(words), F.lit(1))
    return F.struct(
        F.log1p(n).alias("log_words"),
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"),
        share("#*$%&<>!").alias("symbols"),
        share("0123456789").alias("digits"),
        share("|").alias("bars"),
        (F.size(F.array_distinct(words)) / n).alias("distinct"),
        F.log1p(chars / n).alias("word_length"),
        share("\n").alias("lines"),
    )


def _probability(curve):
    centre, scale, w = curve
    z = F.lit(float(w[-1]))
    for name, c, s, x in zip(SHAPE, centre, scale, w, strict=False):
        z = z + (F.col(f"__shape.{name}") - F.lit(float(c))) * F.lit(float(x / s))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _strength(groups: DataFrame, mean: str, towards: str) -> float:
    """Prior strength s of a beta prior: the variance of group means beyond sampling noise is m(1-m)/(s+1)."""
    # groups of one document tell nothing about the spread between groups
    r = groups.filter("n > 1").select((F.pow(F.col(mean) - F.col(towards), 2)).alias("d"), (F.col("var") / F.col("n")).alias("noise"), (F.col(towards) * (1 - F.col(towards))).alias("top")).agg(F.avg("d"), F.avg("noise"), F.avg("top")).first()
    if r[0] is None:
        return 100.0
    between = max(r[0] - r[1], 1e-6)
    return float(min(max(r[2] / between - 1, 1.0), 1e5))


def site_quality(docs: DataFrame, labels: DataFrame, *, host_cols=("source",), path_cols=("source", "lang"), id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """id_col, evidence, host_posterior, path_posterior, score and kept for every row."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg((F.max("quality") > 0).cast("int").alias("__y"))
    known = written(known.select(F.col(id_col).alias("__known"), "__y"), "known")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    sample = known.orderBy(F.xxhash64("__known"), "__known").limit(max_labelled)
    one_text = texts.join(F.broadcast(sample), F.col("__id") == F.col("__known")).groupBy("__known", "__y").agg(F.min("__text").alias("__text"))
    sampled = one_text.select("__y", shape(F.col("__text")).alias("__shape")).select("__y", *[f"__shape.{x}" for x in SHAPE]).toArrow()
    y, *x = (c.to_numpy() for c in sampled.columns)
    columns = list(dict.fromkeys([*host_cols, *path_cols]))
    own = [F.col(c).alias(f"__g{i}") for i, c in enumerate(columns)]  # names that no column of the input has
    hosts_at, paths_at = [f"__g{columns.index(c)}" for c in host_cols], [f"__g{i}" for i in range(len(columns))]
    p = _probability(_logistic(np.column_stack(x), y, float(y.mean()))) if 0 < y.sum() < len(y) else F.lit(float(y.mean()) if len(y) else 1.0)
    shaped = docs.select(F.col(id_col).alias("__id"), *own, shape(F.col(text_col)).alias("__shape"))
    learnt = F.coalesce(F.col("__y").cast("double"), F.col("evidence"))
    # rows without an id have no label; a join by shuffle deals them out by their shape
    part = F.when(F.col("__id").isNull(), F.pmod(F.xxhash64("__shape"), F.lit(4096))).otherwise(F.lit(0).cast("long"))
    every = sized(known.withColumn("__zero", F.lit(0).cast("long")))
    scored = written(shaped.withColumn("__part", part).join(every, (F.col("__id") == F.col("__known")) & (F.col("__part") == F.col("__zero")), "left").select("__id", *paths_at, p.alias("evidence"), "__y").select("__id", *paths_at, "evidence", learnt.alias("__e")), "evidence")
    total = scored.agg(F.avg("__e")).first()[0] or 0.0
    sums = lambda cols: scored.groupBy(*cols).agg(F.count("*").alias("n"), F.sum("__e").alias("s"), F.coalesce(F.var_pop("__e"), F.lit(0.0)).alias("var"))
    same = lambda cols, prefix: [F.col(c).eqNullSafe(F.col(prefix + c)) for c in cols]
    renamed = lambda df, prefix, cols, *more: df.select(*[F.col(c).alias(prefix + c) for c in cols], *more)

    hosts = sums(hosts_at).withColumn("mean", F.col("s") / F.col("n")).withColumn("prior", F.lit(total))
    k_host = _strength(hosts, "mean", "prior")
    hosts = renamed(hosts, "__h", hosts_at, F.col("n").alias("__hn"), F.col("s").alias("__hs"))
    paths = sums(paths_at).join(hosts, same(hosts_at, "__h")).withColumn("mean", F.col("s") / F.col("n")).withColumn("prior", (F.col("__hs") + k_host * total) / (F.col("__hn") + k_host))
    k_path = _strength(paths, "mean", "prior")
    paths = sized(renamed(paths, "__p", paths_at, F.col("n").alias("__pn"), F.col("s").alias("__ps"), "__hn", "__hs"))
    host = (F.col("__hs") - F.col("__e") + k_host * total) / (F.col("__hn") - 1 + k_host)
    path = (F.col("__ps") - F.col("__e") + k_path * F.col("host_posterior")) / (F.col("__pn") - 1 + k_path)
    logit = lambda q: F.log(F.greatest(q, F.lit(1e-6)) / F.greatest(1 - q, F.lit(1e-6)))
    score = 1 / (1 + F.exp(-(logit(F.col("evidence")) + logit(F.col("path_posterior")) - logit(F.lit(total)))))
    joined = scored.join(paths, same(paths_at, "__p")).withColumn("host_posterior", host).withColumn("path_posterior", path)
    return joined.select(F.col("__id").alias(id_col), "evidence", "host_posterior", "path_posterior", score.alias("score"), (score >= threshold).alias("kept"))


def op8_site_quality(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return site_quality(table(spark, sf_dir, "documents"), labels)
