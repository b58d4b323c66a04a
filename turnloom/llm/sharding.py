"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id). Instead of sampling, the driver probes candidate
boundaries: one narrow pass counts the exact bytes below every probe, each boundary's interval
shrinks to the two probes around its target, and the passes go on until every boundary is within
tolerance. Then the rows move once. What the driver holds is a few numbers for each probe.

Boundaries lie between texts, so rows with equal texts share a shard, unless the copies of one text
weigh so much that a boundary between texts would miss its target by more than `whole`; then
the boundary goes between two doc_ids of that text. A text with a third of all rows is
thereby spread evenly.

Defined results: a null text has no bytes and counts as the empty text; a null doc_id
sorts first; equal rows are neighbours with slots of their own; an empty table gives an
empty result; other columns aren't read.
"""

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import table, written
from ._text import released

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Probes in the first pass; for each open boundary in the later ones, and of all boundaries about.
FIRST_PROBES, PROBES, ALL_PROBES = 4096, 256, 1 << 18


def _rank(keys: np.ndarray, ids: np.ndarray, probe_keys: np.ndarray, probe_ids: np.ndarray) -> np.ndarray:
    """For each row the number of probes (sorted by key, id) at or below it."""
    lo = np.searchsorted(probe_keys, keys, "left")
    hi = np.searchsorted(probe_keys, keys, "right")
    for key in np.unique(keys[lo < hi]):
        rows, a, b = keys == key, *np.searchsorted(probe_keys, [key, key + 1] if key < HIGH else [key, key], "left")
        b = len(probe_keys) if key == HIGH else b
        lo[rows] = a + np.searchsorted(probe_ids[a:b], ids[rows], "right")
    return lo


def _histogram(rows: DataFrame, probes: list[tuple[int, int]], weight: str) -> tuple[np.ndarray, ...]:
    """Of the rows from each probe up to the next (first of all those below every probe): exact sum of `weight`,
    least and greatest key, least and greatest id. A task sends one row for each interval that it has rows of."""
    pk = np.array([p[0] for p in probes], np.int64)
    pi = np.array([p[1] for p in probes], np.int64)

    def count(batches):
        total = np.zeros(len(pk) + 1, np.int64)
        least, most = np.full((2, len(pk) + 1), HIGH, np.int64), np.full((2, len(pk) + 1), LOW, np.int64)
        for b in batches:
            key, i, w = (c.to_numpy() for c in b.columns)
            at = _rank(key, i, pk, pi)
            np.add.at(total, at, w)
            for k, x in enumerate((key, i)):
                np.minimum.at(least[k], at, x)
                np.maximum.at(most[k], at, x)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, total[at], least[0, at], most[0, at], least[1, at], most[1, at])], names=["at", "n", "k0", "k1", "i0", "i1"])

    counted = (
        rows.select("key", "id", F.col(weight).alias("w"))
        .mapInArrow(released(count), "at long, n long, k0 long, k1 long, i0 long, i1 long")
        .groupBy("at")
        .agg(F.sum("n"), F.min("k0"), F.max("k1"), F.min("i0"), F.max("i1"))
        .toArrow()
    )
    out = [np.full(len(pk) + 1, x, np.int64) for x in (0, HIGH, LOW, HIGH, LOW)]
    at = counted.column(0).to_numpy()
    for k in range(5):
        out[k][at] = counted.column(k + 1).to_numpy()
    return tuple(out)


class _Cut:
    """One boundary: the interval that holds it, and the best probe so far."""

    def __init__(self, target: float):
        self.target, self.key, self.lo, self.hi, self.best, self.error, self.open = target, None, LOW, HIGH, (LOW, LOW), target, True

    def probes(self, n: int) -> list[tuple[int, int]]:
        """About n places in the interval, in order."""
        steps = sorted({self.lo + (self.hi - self.lo) * k // n for k in range(n + 1)} | {min(self.hi + 1, HIGH)})
        return [(x, LOW) if self.key is None else (self.key, x) for x in steps]

    def learn(self, probes, own: slice, below, found, tolerance: float, whole: float) -> None:
        """own: where this boundary's interval is in probes; below: for each probe the weight below it, which never falls."""
        place = own.start + int(np.searchsorted(below[own], self.target, "right"))  # the first probe over the target
        for p in (place - 1, place):
            if own.start <= p < own.stop and abs(below[p] - self.target) < self.error:
                self.best, self.error = probes[p], abs(below[p] - self.target)
        if self.error <= tolerance:
            self.open = False
            return
        # the interval between the last probe under the target and the first one over it, shrunk to the rows that it holds
        n, k0, k1, i0, i1 = (int(x[place]) for x in found)
        if not n:
            self.open = False
        elif self.key is None and k0 < k1:
            self.lo, self.hi = k0, k1
        elif self.key is None and self.error > whole:  # one text; the boundary goes between two of its ids
            self.key, self.lo, self.hi = k0, i0, i1
        elif self.key is not None and i0 < i1:
            self.lo, self.hi = i0, i1
        else:
            self.open = False


def find_splitters(rows: DataFrame, parts: int, total: int, weight: str, *, tolerance: float, whole: float) -> list[tuple[int, int]]:
    """parts - 1 boundaries (key, id) that cut rows(key, id, weight) into parts of nearly equal weight.

    tolerance, whole: as shares of a part's weight; see the module.
    """
    mean = total / parts
    cuts = [_Cut(total * j / parts) for j in range(1, parts)]
    n_probes = FIRST_PROBES
    while open_cuts := [c for c in cuts if c.open]:
        # boundaries in the same interval, as all are at first, share its probes
        shared = {(c.key, c.lo, c.hi): c for c in open_cuts}
        probes = sorted({p for c in shared.values() for p in c.probes(n_probes)})
        found = _histogram(rows, probes, weight)
        below = np.cumsum(found[0])[:-1]
        for c in open_cuts:
            c.learn(probes, slice(0, len(probes)), below, found, tolerance * mean, whole * mean)
        n_probes = max(8, min(PROBES, ALL_PROBES // len(open_cuts)))
    return sorted(c.best for c in cuts)


def histogram_shards(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, whole: float = 0.03, rows_per_range: int = 1_000_000) -> DataFrame:
    """id_col, size, text_crc32, key, shard, slot: sizes of the shards near equal, slots gapless from 0.

    Slots come from exact counts of ranges of about rows_per_range rows, so no task sorts a shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(F.xxhash64(text).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(1).cast("long").alias("one")),
        "shard-keys",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cuts = find_splitters(rows, shards, total, "size", tolerance=tolerance, whole=whole) if n else []
    ranges = max(1, n // rows_per_range)
    fine = sorted({*cuts, *(find_splitters(rows, ranges, n, "one", tolerance=0.3, whole=0.3) if ranges > 1 else [])})
    before = [0, *(np.cumsum(_histogram(rows, fine, "one")[0])[:-1].tolist() if fine else [])]
    # more shards than rows: some stay empty, and the boundaries of equal place count once each
    shard_of = np.array([0, *(bisect.bisect_right(cuts, f) for f in fine)])
    first = np.array(before, np.int64)[np.unique(shard_of, return_index=True)[1]][np.unique(shard_of, return_inverse=True)[1]]
    pk, pi = np.array([f[0] for f in fine], np.int64), np.array([f[1] for f in fine], np.int64)
    shard_at, start_at = shard_of.astype(np.int32), np.array(before, np.int64) - first

    def place(batches):
        for b in batches:
            at = _rank(b.column(0).to_numpy(), b.column(1).to_numpy(), pk, pi)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(shard_at[at]), pa.array(start_at[at])], names=[*b.schema.names, "range", "shard", "start"])

    placed = rows.select("key", "id", "size", "text_crc32").mapInArrow(released(place), "key long, id long, size long, text_crc32 long, range int, shard int, start long")
    in_range = Window.partitionBy("range").orderBy("key", "id")
    return placed.select(
        F.nullif(F.col("id"), F.lit(LOW)).alias(id_col), "size", "text_crc32", "key", "shard", (F.col("start") + F.row_number().over(in_range) - 1).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", files_per_shard: int = 1) -> None:
    """The documents as one folder for each shard, rows in slot order within a file."""
    # rows are the placement's by text hash and id (null for none), and rows equal in both one by one
    same = Window.partitionBy("__key", "__id")
    docs = docs.withColumns({"__key": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(LOW))})
    docs = docs.withColumn("__n", F.row_number().over(same.orderBy(F.lit(0))))
    own = placed.select(F.col("key").alias("__key"), F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("__id"), "shard", "slot")
    own = own.withColumn("__n", F.row_number().over(same.orderBy("shard", "slot")))
    docs = docs.join(own, ["__key", "__id", "__n"]).drop("__key", "__id", "__n")
    docs.repartition("shard", (F.col("slot") % files_per_shard)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_histogram_sharding(spark, sf_dir: str) -> DataFrame:
    placed = histogram_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
