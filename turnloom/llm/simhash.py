"""SimHash near-duplicates with bit-sliced comparison.

1. Fingerprints: 3-word shingles of the whole text, hashed by XXH64 in numpy; majority bits.
   (The contract of the query fixes three words and two bits, in place of five words and 0.8.)
2. Candidates: two fingerprints that differ in at most `radius` bits agree on at least two of radius + 2
   blocks of bits, so each pair of blocks is a bucket key: six of 32 bits for two bits. Keys get more and
   shorter with the radius, so a large one compares far more pairs.
3. Buckets hold distinct fingerprints only. In a bucket the bits stand vertically, 64 fingerprints to
   a word; carry-save counters add up the differing bits of 64 pairs at a time, and words in which
   every pair is beyond the radius are abandoned. A bucket of more than BLOCK fingerprints is cut
   into parts, and each pair of parts is a task of its own, so no bucket gathers in one task.
   Only a spanning forest of a block's links leaves it, never all pairs.
4. Components by alternating large-star and small-star steps on the forest's edges.

Defined results: null and empty texts have fingerprint zero and link like any other; a null
doc_id gets the component of its fingerprint, whose id is the smallest doc_id that isn't null
(null if all are); repeated rows are returned as often as they come; an empty table gives an
empty result; other columns aren't read.
"""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, shared_dir, table, written
from ._text import LOWER, released, slices, word_bounds

#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
SEED = 42
#: Fingerprints in one block of a bucket.
BLOCK = 2048
LANES = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each data[start:end]."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.array(np.ndarray((len(padded) - 7,), "<u8", padded.data, 0, (1,)))
    n = ends - starts
    wrapped = [np.uint64(x % (1 << 64)) for x in (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1), seed + int(P5))]
    h = np.full(len(starts), wrapped[4], np.uint64)
    at = starts.copy()
    long = np.flatnonzero(n >= 32)
    if len(long):
        acc = [np.full(len(long), x, np.uint64) for x in wrapped[:4]]
        active, where = np.arange(len(long)), at[long]
        stripes = n[long] // 32
        k = 0
        while len(active):
            for i in range(4):
                lane = eight[where[active] + 32 * k + 8 * i]
                acc[i][active] = _rotl(acc[i][active] + lane * P2, 31) * P1
            k += 1
            active = active[stripes[active] > k]
        m = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            m = (m ^ _rotl(a * P2, 31) * P1) * P1 + P4
        h[long] = m
        at[long] += stripes * 32
    h += n.astype(np.uint64)
    rows = np.arange(len(starts))
    while len(rows := rows[ends[rows] - at[rows] >= 8]):
        h[rows] = _rotl(h[rows] ^ _rotl(eight[at[rows]] * P2, 31) * P1, 27) * P1 + P4
        at[rows] += 8
    rows = np.flatnonzero(ends - at >= 4)
    h[rows] = _rotl(h[rows] ^ (eight[at[rows]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    at[rows] += 4
    rows = np.arange(len(starts))
    while len(rows := rows[ends[rows] > at[rows]]):
        h[rows] = _rotl(h[rows] ^ padded[at[rows]].astype(np.uint64) * P5, 11) * P1
        at[rows] += 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    return h ^ h >> np.uint64(32)


def simhash(data: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    """Fingerprint of each text; data holds the texts one after the other."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    n_texts, n_words = len(offsets) - 1, len(starts)
    out = np.zeros(n_texts, np.uint64)
    if not n_words:
        return out
    lengths = ends - starts
    new_end = np.cumsum(lengths + 1) - 1
    new_start = new_end - lengths
    spaced = np.full(int(new_end[-1]) + 1, 32, np.uint8)
    word_byte = np.repeat(starts - new_start, lengths)
    at = np.arange(len(word_byte)) + np.repeat(np.arange(n_words), lengths)
    spaced[at] = data[at + word_byte]
    words = np.diff(first)
    n_shingles = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    owner = np.repeat(np.arange(n_texts), n_shingles)
    begin = np.cumsum(n_shingles) - n_shingles
    from_word = np.arange(len(owner)) - begin[owner] + first[owner]
    to_word = np.minimum(from_word + shingle - 1, first[owner + 1] - 1)
    h = xxh64(spaced, new_start[from_word], new_end[to_word])
    # counts of set bits, eight at a time in the bytes of a word, over blocks of at most 255 shingles
    block = np.arange(len(owner)) - begin[owner]
    edges = np.flatnonzero(block % 255 == 0)
    block_owner = owner[edges]
    ones = np.zeros((n_texts, 64), np.int64)
    for b in range(8):
        sums = np.add.reduceat(h >> np.uint64(b) & np.uint64(0x0101010101010101), edges)
        np.add.at(ones, (block_owner[:, None], np.arange(b, 64, 8)), sums.view(np.uint8).reshape(-1, 8))
    bits = ones * 2 > n_shingles[:, None]
    return (bits * LANES).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """id_col, the columns in keep, and fp, the fingerprint as a signed long."""
    own = [id_col, *keep]

    def run(batches):
        for b in batches:
            parts = [simhash(data, offsets, shingle) for _, _, data, offsets in slices(b.column(len(own)))]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*own, "fp"])

    return docs.select(*own, text_col).mapInArrow(released(run), ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in own) + ", fp long")


class _Counters:
    """Carry-save counters of 64 lanes to a word, as many planes as the radius needs."""

    def __init__(self, n: int, radius: int):
        self.radius = radius
        self.planes = [np.zeros(n, np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.over = np.zeros(n, np.uint64)

    def add(self, carry: np.ndarray) -> None:
        for plane in self.planes:
            more = plane & carry
            plane ^= carry
            carry = more
        self.over |= carry

    def beyond(self) -> np.ndarray:
        """Lanes whose count is over the radius."""
        over, equal = self.over.copy(), np.full(len(self.over), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in reversed(range(len(self.planes))):
            if not self.radius >> k & 1:
                over |= equal & self.planes[k]
                equal &= ~self.planes[k]
            else:
                equal &= self.planes[k]
        return over

    def keep(self, alive: np.ndarray) -> None:
        self.planes, self.over = [p[alive] for p in self.planes], self.over[alive]


def _checked(radius: int) -> int:
    if not isinstance(radius, int) or not 0 <= radius <= 62:
        raise ValueError(f"radius has to be a whole number from 0 to 62, not {radius!r}")
    return radius


def _near(queries: np.ndarray, planes: np.ndarray, radius: int, lanes: int = 4096):
    """(query, word of planes, lanes within the radius). planes: [word, bit]. Yields arrays for blocks of pairs."""
    n_words = len(planes)
    step = max(1, lanes * 16 // n_words)
    for lo in range(0, len(queries), step):
        q = queries[lo : lo + step]
        qi, wi = np.repeat(np.arange(len(q)), n_words), np.tile(np.arange(n_words), len(q))
        counters = _Counters(len(qi), radius)
        for bit in range(64):
            counters.add(planes[wi, bit] ^ (np.uint64(0) - (q[qi] >> np.uint64(bit) & np.uint64(1))))
            if bit % 8 == 7:
                alive = counters.beyond() != np.uint64(0xFFFFFFFFFFFFFFFF)
                if alive.sum() < 0.7 * len(alive):
                    qi, wi = qi[alive], wi[alive]
                    counters.keep(alive)
        beyond = counters.beyond()
        hit = np.flatnonzero(~beyond)
        yield lo + qi[hit], wi[hit], ~beyond[hit]


def local_forest(fps: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of distinct fingerprints (uint64) of equal group within the radius, as a forest: (node, root) pairs of places in fps."""
    root = np.arange(len(fps))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):  # hook the larger root to the smaller, then flatten
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            open_ = low != high
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            np.minimum.at(root, high, low)
            while (root != (up := root[root])).any():
                root[:] = up

    bounds = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]])) if len(fps) else np.zeros(1, int)
    sizes = np.diff(bounds)
    small = np.flatnonzero((sizes > 1) & (sizes <= 64))
    # small buckets: one word of planes for each; every fingerprint meets its own bucket's word
    for part in np.array_split(small, max(1, int(sizes[small].sum()) // 8192 + 1)):
        if not len(part):
            continue
        size, base = sizes[part], bounds[part]
        word = np.repeat(np.arange(len(part)), size)
        lane = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(base, size) + lane
        f = fps[place]
        counters = _Counters(len(f), radius)
        starts = np.cumsum(size) - size
        qi = np.arange(len(f))
        for bit in range(64):
            own = f >> np.uint64(bit) & np.uint64(1)
            plane = np.bitwise_or.reduceat(own << lane.astype(np.uint64), starts)
            counters.add(plane[word[qi]] ^ (np.uint64(0) - own[qi]))
        close = ~counters.beyond() & ((LANES - np.uint64(1))[lane])  # earlier lanes only: each link once
        some = np.flatnonzero(close)
        q, other = np.nonzero(close[some, None] & LANES)
        join(place[some[q]], np.repeat(base, size)[some[q]] + other)
    for k in np.flatnonzero(sizes > 64):
        lo, hi = bounds[k], bounds[k + 1]
        f = fps[lo:hi]
        n_words = -(-len(f) // 64)
        lanes = np.zeros(n_words * 64, np.uint64)
        lanes[: len(f)] = f
        lanes = lanes.reshape(n_words, 64)
        planes = np.stack([((lanes >> np.uint64(bit) & np.uint64(1)) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for bit in range(64)], axis=1)
        for q, w, hit in _near(f, planes, radius):
            for at in range(0, len(q), 1 << 14):
                row, lane = np.nonzero(hit[at : at + (1 << 14), None] & LANES)
                a, b = q[at + row], w[at + row] * 64 + lane
                earlier = b < a  # drops the padding and each link's second sight too
                join(lo + a[earlier], lo + b[earlier])
    node = np.flatnonzero(root != np.arange(len(fps)))
    return node, root[node]


def _block_pairs(keys: DataFrame, block: int) -> DataFrame:
    """keys(t, key, fp) of buckets with two or more; large ones as pairs of parts (i <= j)."""
    counts = keys.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    parted = keys.join(counts, ["t", "key"]).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    return parted.withColumn("pair", F.explode(pairs)).select("t", "key", "pair.i", "pair.j", "fp")


def near_links(distinct: DataFrame, *, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Edges (a, b), a > b, that connect all fingerprints of distinct(fp) within the radius."""
    edges = [64 * i // (_checked(radius) + 2) for i in range(radius + 3)]
    blocks = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << hi - lo) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    widths = [hi - lo for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), (F.shiftleft(blocks[i].cast("long"), widths[j]).bitwiseOR(blocks[j])).cast("long").alias("key")) for t, (i, j) in enumerate(itertools.combinations(range(radius + 2), 2))])).alias("k"),
    ).select("k.t", "k.key", "fp")
    grouped = _block_pairs(keys, block).repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def run(batches):
        held = None
        for last, b in _with_last(batches):
            cols = [c.to_numpy() for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            group = np.zeros(len(cols[0]), np.int64)
            if len(group):
                group[1:] = np.cumsum(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0))
            cut = len(group) if last else int(np.searchsorted(group, group[-1])) if len(group) else 0
            held = [c[cut:] for c in cols]
            fps = cols[4][:cut]
            a, b_ = local_forest(fps.view(np.uint64), group[:cut], radius)
            a, b_ = fps[a], fps[b_]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b_)), pa.array(np.minimum(a, b_))], names=["a", "b"])

    return grouped.mapInArrow(released(run), "a long, b long").distinct()


def _with_last(batches):
    before = None
    for b in batches:
        if before is not None:
            yield False, before
        before = b
    if before is not None:
        yield True, before


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for edges (a, b), a > b. Nodes without edges don't appear."""
    spark = edges.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    edges = edges.checkpoint()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(edges.join(least, "a").filter("m = b").select("a", "b")).filter("a > b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        edges = small.checkpoint()
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """id_col, the columns in keep, fp, component_id and root (the component's smallest fingerprint, which no other has) for every row."""
    _checked(radius)
    fps = written(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col, keep=keep), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(near_links(distinct.select("fp"), radius=radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select(id_col, *keep, "fp", "component_id", "root")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


__all__ = ["components", "discard", "fingerprints", "near_duplicates", "near_links", "op7_simhash", "simhash", "xxh64"]
