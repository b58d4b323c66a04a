"""Means of vectors and what lies near them. A vector goes through a shuffle whole, as one partial sum of each task and group."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import cosine, unit_vector


def mean_vectors(vectors: DataFrame, key: str, *, vector: str = "embedding") -> DataFrame:
    """AGG-18: the mean of each group's vectors, to length one. Null vectors don't count; a group without others has no row."""
    doubles = F.col(vector).cast("array<double>")
    means = vectors.filter(F.col(vector).isNotNull()).select(key, array_to_vector(doubles).alias("v")).groupBy(key).agg(Summarizer.mean(F.col("v")).alias("m"))
    return means.select(key, unit_vector(vector_to_array("m")).alias("mean"))


def to_mean(vectors: DataFrame, key: str, *, vector: str = "embedding") -> DataFrame:
    """FN-16: vectors with cosine, how near each is to its group's mean."""
    return vectors.join(mean_vectors(vectors, key, vector=vector), key).withColumn("cosine", cosine(F.col(vector), F.col("mean"))).drop("mean")


def representative(tracks: DataFrame, key: str, track: Column, frames: Column) -> DataFrame:
    """AGG-11: of each group the track with most frames (at least one counts), the first of equals; groups without any frame have none."""
    g = tracks.groupBy(key).agg(F.sum(frames).alias("n"), F.max_by(track, F.struct(F.greatest(frames, F.lit(1)), -track)).alias("best"))
    return g.filter("n > 0").select(key, "best")
