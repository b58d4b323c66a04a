"""Repeated passages by a depth-limited radix sort of suffixes.

A passage of WINDOW bytes is repeated if two suffixes agree in their first WINDOW bytes. Suffixes are
told apart by most-significant-digit passes, and a suffix that is alone in its group after a pass
goes no further:

1. First digit: GRAM bytes. Not every suffix needs to be sorted: of the suffixes in a window one is
   its anchor, the leftmost with the least hash of its first digit. Equal windows have equal
   anchors at equal places, so windows are grouped by the anchors' digits, and the consecutive
   windows of one anchor go as one row. Rows whose digit occurs once are dropped.
2. Second digit: all bytes of the row's windows. Rows that agree in it repeat each other whole; the
   first of them in (doc_id, start) order stands for all, the others' bytes are removed.
3. Third and fourth digit, only where rows share the first but not the second: a standing row's windows in
   blocks of BLOCK, dealt by their place against the anchor; first by the bytes that all windows of a
   block have in common, then by all bytes of the block's windows.
4. Last digit, only where blocks share the third digit but not the fourth: single windows, each by all its
   WINDOW bytes. What remains equal is exactly the repeated windows.

Digits longer than a word are compared by hashes (64 bits for each, so 128 for two passes in a row; 128 for the last).
Every pass is a grouped minimum with partial aggregation and a join back, so a passage that a third of
all documents share is one row for each task before it is shuffled; the join back deals the rows of such a group over many tasks.

Defined results: null and empty texts have no bytes and lose none; a null doc_id counts as
smaller than all others; rows that share a doc_id and the text are one document, so exactly repeated rows
don't remove each other; rows that share a doc_id (or have none) but not the text are documents of their own, in the order of
their texts' hashes; an empty table gives an empty result; other columns aren't read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import MOST_IDS, discard, sized, table, written
from ._text import buffers, mixed, prefix_sums, released, slices, span_hash

WINDOW, GRAM = 100, 24
BLOCK = 16
#: A group with more than this part of all rows is dealt over several tasks.
PARTS = 4096
#: Bytes of one text that are worked on at a time.
TILE = 1 << 20
#: Bytes of several texts that are put end to end; a longer text stands alone.
TOGETHER = 1 << 18
LOW = -(1 << 63)
_OTHER = ((np.arange(256) * 167 + 13) % 256).astype(np.uint8)


def anchor_rows(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Rows of windows with a common anchor: text's index, first window's start in the text, number of windows, the anchor's distance from the first start, first and second digit (hashes)."""
    n = len(data)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = prefix_sums(data)
    at = np.arange(n - gram + 1)
    digit = span_hash(sums, at, at + gram)
    key = digit & np.uint64(0xFFFFFFFFFF000000) | at.astype(np.uint64)  # least hash, then leftmost
    span, least = 1, key
    width = window - gram + 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: n - window + 1], least[width - span : width - span + n - window + 1])
    edge = np.zeros(n + 1, np.int32)
    lengths = np.diff(offsets)
    whole = lengths >= window
    np.add.at(edge, offsets[:-1][whole], 1)
    np.add.at(edge, offsets[1:][whole] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge)[: n - window + 1])
    if not len(starts):
        return anchor_rows(data[:0], offsets[:1])
    anchor = (least[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    a, b, p = starts[first], starts[last], anchor[first]
    text = np.searchsorted(offsets, a, "right") - 1
    second = mixed(span_hash(sums, a, b + window) ^ mixed(((p - a) * 128 + (b - a)).astype(np.uint64)))
    return text, a - offsets[text], b - a + 1, p - a, digit[p], second


def _tiles(column):
    """(first row, bytes, offsets, start of the bytes in their text): slices, long texts in overlapping tiles."""
    for lo, _, data, offsets in slices(column, TILE):
        if len(data) <= 2 * TILE:
            yield lo, data, offsets, 0
        else:
            for at in range(0, len(data), TILE):
                part = data[at : at + TILE + WINDOW - 1]
                yield lo, part, np.array([0, len(part)]), at


def _with_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("doc"), F.col(text_col).alias("text"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __doc, a long in the order of the ids: the id itself, or, if any id has several texts, a number for each (id, text)."""
    own = {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)), "__hash": F.xxhash64(text_col)}
    ids = docs.select(*[c.alias(name) for name, c in own.items()]).distinct()
    if ids.groupBy("__id").count().filter("count > 1").isEmpty():
        return docs.withColumn("__doc", own["__id"])
    # increases from one range to the next, and within each
    numbers = written(ids.repartitionByRange("__id", "__hash").sortWithinPartitions("__id", "__hash").withColumn("__doc", F.monotonically_increasing_id()), "numbers")
    return written(docs.withColumns(own).join(numbers, ["__id", "__hash"]).select(*docs.columns, "__doc"), "numbered")


def _anchors(docs: DataFrame) -> DataFrame:
    """docs: doc, text. key, full: first and second digit; doc, start, n: where the row's windows start and how many they are; lead: the anchor's distance from start."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, data, offsets, base in _tiles(b.column(1)):
                text, start, n, lead, h, c = anchor_rows(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(ids[lo + text]), pa.array(start + base), pa.array(n.astype(np.int32)), pa.array(lead.astype(np.int32))], names=["key", "full", "doc", "start", "n", "lead"])

    return docs.mapInArrow(released(run), "key long, full long, doc long, start long, n int, lead int")


def _of_groups(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with groups, a written table with the number of each group's rows. A group with over 1 / PARTS of all rows goes to one task for each such part; fewer than PARTS groups are so, and their keys are broadcast."""
    most = (groups.agg(F.sum("rows")).first()[0] or 0) // PARTS + 1
    parts = F.ceil(F.col("rows") / most)
    hot = F.broadcast(groups.filter(F.col("rows") > most).select(*on, parts.alias("parts")))
    # rows come straight from a scan, so a task that is run again numbers them as before
    dealt = rows.join(hot, on, "left").withColumn("part", F.coalesce(F.pmod(F.monotonically_increasing_id(), "parts"), F.lit(0))).drop("parts")
    return dealt.join(groups.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("rows"), [*on, "part"]).drop("part")


def _settle(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """rows: key, full, doc, start, n, lead. Spans of the rows that repeat an earlier one whole, and the standing rows whose key others share with another full; and the tables that both read."""
    keys = written(rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("full").alias("f0"), F.max("full").alias("f1")).filter("rows > 1").select("key", "rows", (F.col("f0") != F.col("f1")).alias("differ")), name + "-keys")
    kept = written(_of_groups(rows, keys, ["key"]), name)
    discard(keys)
    stands = written(kept.groupBy("key", "full").agg(F.min(F.struct("doc", "start")).alias("first"), F.first(F.struct("n", "lead", "differ")).alias("row"), F.count("*").alias("rows")), name + "-first")
    later = _of_groups(kept, stands.filter("rows > 1").select("key", "full", "first", "rows"), ["key", "full"]).filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return later.select("doc", "start", (F.col("start") + F.col("n") - 1 + WINDOW).alias("end")), stands.filter("row.differ").select("first.doc", "first.start", "row.n", "row.lead"), [kept, stands]


def _packed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc and the compressed text z of (at least) the documents in ids(doc)."""
    few = ids.limit(MOST_IDS + 1).toArrow().column(0).to_numpy()
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(few) if len(few) <= MOST_IDS else None)

    def run(batches):
        known = wanted.value
        codec = pa.Codec("zstd", compression_level=1)
        for b in batches:
            if known is not None:
                own = b.column(0).to_numpy()
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                b = b.filter(pa.array(known[at] == own)) if len(known) else b.slice(0, 0)
            data, offsets = buffers(b.column(1))
            z = [codec.compress(data[i:j].tobytes(), asbytes=True) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(z, pa.binary())], names=["doc", "n_bytes", "z"])

    return docs.mapInArrow(released(run), "doc long, n_bytes long, z binary")


def _unpack(z: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(z, n), np.uint8) if n else np.zeros(0, np.uint8)


def _with_text(docs: DataFrame, rows: DataFrame, of_rows, schema: str) -> DataFrame:
    """of_rows(bytes, offsets, ids, owner, starts, ns, leads) over the documents of rows(doc, start, n, lead), several of them end to end; owner is a row's document, starts are places in bytes."""
    by_doc = rows.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "lead")).alias("rows"))

    def run(batches):
        for b in batches:
            ids, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
            total = np.concatenate([[0], np.cumsum(sizes)])
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + TOGETHER, "right")) - 1)
                data = np.concatenate([_unpack(b.column(2)[i].as_py(), int(sizes[i])) for i in range(lo, hi)])
                lists = b.column(3).slice(lo, hi - lo)
                owner, own = np.repeat(np.arange(hi - lo), pc.list_value_length(lists).to_numpy()), lists.flatten()
                start, n, lead = (own.field(k).to_numpy().astype(np.int64) for k in range(3))
                ok = start + n - 1 + WINDOW <= sizes[lo:hi][owner]
                owner = owner[ok]
                offsets = total[lo : hi + 1] - total[lo]
                yield of_rows(data, offsets, ids[lo:hi], owner, start[ok] + offsets[owner], n[ok], lead[ok])
                lo = hi

    return _packed(docs, by_doc.select("doc")).join(by_doc, "doc").select("doc", "n_bytes", "z", "rows").mapInArrow(released(run), schema)


def _blocks(data, offsets, ids, owner, start, n, lead):
    anchor, last = start + lead, start + n - 1
    k0, k1 = (anchor - last) // BLOCK, lead // BLOCK  # windows by their distance before the anchor
    many = k1 - k0 + 1
    row = np.repeat(np.arange(len(start)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + k0[row]
    high, low = anchor[row] - BLOCK * k, anchor[row] - BLOCK * k - BLOCK + 1
    a, b = np.maximum(low, start[row]), np.minimum(high, last[row])
    sums = prefix_sums(data)
    # low may lie before the text, but what all windows from low to high share lies in each of them
    key = mixed(span_hash(sums, high, low + WINDOW) ^ mixed(k.astype(np.uint64)))
    full = mixed(span_hash(sums, a, b + WINDOW) ^ mixed(((high - a) * 128 + (b - a)).astype(np.uint64)))
    own = owner[row]
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(full.view(np.int64)), pa.array(ids[own]), pa.array(a - offsets[own]), pa.array((b - a + 1).astype(np.int32)), pa.array(np.zeros(len(a), np.int32))],
        names=["key", "full", "doc", "start", "n", "lead"],
    )


def _single(data, offsets, ids, owner, start, n, lead):
    at = np.unique(np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    own = np.searchsorted(offsets, at, "right") - 1
    w1 = span_hash(prefix_sums(data), at, at + WINDOW)
    w2 = span_hash(prefix_sums(_OTHER[data]), at, at + WINDOW)
    return pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(ids[own]), pa.array(at - offsets[own])], names=["w1", "w2", "doc", "start"])


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and spans, an array of (start, end) in bytes, of the documents that repeat earlier passages. Spans may overlap. A table of its own."""
    docs = _with_id(docs, id_col, text_col)
    of_rows, open_rows, rows = _settle(_anchors(docs), "repeated-rows")
    blocks = written(_with_text(docs, open_rows, _blocks, "key long, full long, doc long, start long, n int, lead int"), "blocks")
    of_blocks, open_blocks, same_blocks = _settle(blocks, "repeated-blocks")
    windows = written(_with_text(docs, open_blocks, _single, "w1 long, w2 long, doc long, start long"), "windows")
    earliest = written(windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("rows")).filter("rows > 1"), "earliest")
    again = _of_groups(windows, earliest, ["w1", "w2"]).filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    spans = of_rows.unionByName(of_blocks).unionByName(again.select("doc", "start", (F.col("start") + WINDOW).alias("end")))
    out = written(spans.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    for done in (*rows, blocks, *same_blocks, windows, earliest):
        discard(done)
    return out


def merged(starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = np.minimum(starts[order], length), np.minimum(ends[order], length)
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    runs = np.flatnonzero(first)
    return starts[runs], reach[np.concatenate([runs[1:], [len(starts)]]) - 1]


def cut(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans and kept (the bytes left; as_text: what is whole characters of them) for the documents in spans."""

    def batch(ids, rows):
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    def run(batches):
        for b in batches:
            lo, rows, size = 0, [], 0
            for i in range(b.num_rows):
                data, own = _unpack(b.column(2)[i].as_py(), b.column(1)[i].as_py()), b.column(3)[i].values
                a, e = merged(own.field(0).to_numpy(), own.field(1).to_numpy(), len(data))
                left = b"".join(data[x:y].tobytes() for x, y in zip([0, *e.tolist()], [*a.tolist(), len(data)], strict=True))
                rows.append((len(data), len(data) - len(left), len(a), left.decode("utf-8", "ignore") if as_text else left))
                size += len(left)
                if size >= TOGETHER or i + 1 == b.num_rows:
                    yield batch(b.column(0).slice(lo, i + 1 - lo), rows)
                    lo, rows, size = i + 1, [], 0

    docs = _with_id(docs, id_col, text_col)
    schema = f"doc long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"
    return _packed(docs, spans.select("doc")).join(spans, "doc").select("doc", "n_bytes", "z", "spans").mapInArrow(released(run), schema)


def deduplicated_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut from text_col. A character that a cut divides goes too."""
    columns = docs.columns
    # other columns go along as one, so that none clashes with those made here
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col]).alias("rest"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = _numbered(docs, "id", "text")
    spans = repeated_spans(docs, id_col="__doc")
    left = written(cut(docs, spans, id_col="__doc", as_text=True).select("doc", "kept"), "cut")  # in small batches, whoever writes the result
    texts = left.select(F.col("doc").alias("__doc"), F.col("kept").alias("text")).dropDuplicates(["__doc"])
    untouched = docs.join(sized(spans.select(F.col("doc").alias("__doc"))), "__doc", "left_anti").select("rest", "text")
    touched = docs.select("rest", "__doc").join(texts, "__doc").select("rest", "text")
    return untouched.unionByName(touched).select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in columns])


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = _numbered(table(spark, sf_dir, "documents"), "doc_id", "text")
    spans = repeated_spans(docs, id_col="__doc")
    left = written(cut(docs, spans, id_col="__doc").select("doc", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha")), "cut").dropDuplicates(["doc"])
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.col("__doc").alias("doc"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole_sha"))
    return own.join(left, "doc", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("cut_sha", "whole_sha").alias("kept_sha256")
    )
