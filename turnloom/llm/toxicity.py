"""Toxicity by class-conditional Kneser-Ney models.

Two word models, one of toxic and one of ordinary texts, back off from word pairs to words, to stems
(a word's first bytes) and at last to counts that both classes share: of every document of the
corpus, in how many contexts a word and a stem occur (the continuation counts of Kneser-Ney). An
expression too rare for either class thereby gets nearly the same probability from both. A text's
evidence is the difference of its two log-likelihoods, divided by its length; a logistic
curve over it, fitted by cross-fitting on the labelled texts, gives the score.

Counts are exact and keyed by the full 64-bit hash of a word, stem or pair, however many there are.
Only expressions that the classes are told apart by, and the words and stems that those rest on, have a
ratio of their own; for every other one the shared counts cancel and the ratio is one constant. So all
contexts of the corpus are counted, by groupBy, and only the counts of the former travel; these are
bounded by the labelled texts. The classes are fitted on at most MAX_LABELLED labelled
texts each; the shared counts cover all texts.

Defined results: null and empty texts have no evidence and score the calibrated value at zero;
of several labels of a doc_id a toxic one wins; of several texts of a labelled doc_id the least is learnt from; null labels and labels without a document aren't
learnt from; repeated rows are scored each for itself; without labels of both classes every score is 0; an empty
table gives an empty result; other columns aren't read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, small_batches, table, written
from ._text import LOWER, NOT_ALNUM, prefix_sums, released, slices, span_hash, word_bounds

#: Labelled texts of each class that the class models are fitted on, at most.
MAX_LABELLED = 10_000
STEM_BYTES = 5
#: Windows in which the strongest passage is sought.
PASSAGE = 64
# What is counted: in all texts contexts of words and stems; in the texts of a class (of a fold) words, stems and pairs.
WORDS, STEMS, PAIRS = range(3)


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Hash of each word, of its stem and of the word before it (0 at a text's start), and each text's first word."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, NOT_ALNUM)
    sums = prefix_sums(data)
    words = span_hash(sums, starts, ends)
    stems = span_hash(sums, starts, np.minimum(ends, starts + STEM_BYTES))
    before = np.zeros_like(words)
    before[1:] = words[:-1]
    before[first[:-1][first[:-1] < len(words)]] = 0
    return words, stems, before, first


def _pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (before * np.uint64(0x9E3779B97F4A7C15)) ^ words


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


DISCOUNT = 0.75
REPEATS = 4
#: How many times the chance level, in nats, a split has to gain at most.
GAIN = 2.0


def class_counts(labelled: DataFrame) -> DataFrame:
    """labelled: text, label + 2 * fold. what, fold, at (full hash), stem and before (0 where there is none), ordinary and toxic: counts in the texts of both classes.

    One text counts at most REPEATS times for an expression, so one that repeats itself is few witnesses.
    """

    def run(batches):
        for b in batches:
            label = b.column(1).to_numpy()
            for lo, _, data, offsets in slices(b.column(0)):
                words, stems, before, first = _tokens(data, offsets)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                none = np.zeros_like(words)
                for what, h, stem, ctx in ((WORDS, words, stems, none), (STEMS, stems, stems, none), (PAIRS, _pair(before, words), stems, before)):
                    order = np.lexsort((h, text))
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(text[order]) != 0) | (h[order][1:] != h[order][:-1])])) if len(h) else np.zeros(0, int)
                    n = np.minimum(np.diff(np.append(new, len(h))), REPEATS)
                    at = order[new]
                    own = label[lo + text[at]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), what, np.int32)), pa.array((own >> 1).astype(np.int32)), _signed(h[at]), _signed(stem[at]), _signed(ctx[at]), pa.array(np.where(own & 1, 0, n)), pa.array(np.where(own & 1, n, 0))],
                        names=["what", "fold", "at", "stem", "before", "ordinary", "toxic"],
                    )

    rows = labelled.mapInArrow(released(run), "what int, fold int, at long, stem long, before long, ordinary long, toxic long")
    return rows.groupBy("what", "fold", "at", "stem", "before").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def told_apart(counts: DataFrame, sizes: dict) -> DataFrame:
    """The rows of counts whose split between the classes may not be chance; sizes: row of sums for each (what, fold).

    The log-likelihood of its split, against a split by the classes' sizes, has to exceed the
    logarithm of how many expressions there are, so hardly one in all passes by chance.
    """
    sure = F.lit(False)
    for (what, fold), r in sizes.items():
        share = r.toxic / max(r.ordinary + r.toxic, 1)
        if not 0 < share < 1:  # one class only: nothing can gain
            continue
        both = F.col("ordinary") + F.col("toxic")
        gain = [F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * part))).otherwise(0.0) for c, part in (("toxic", share), ("ordinary", 1 - share))]
        # copies of a text aren't independent, and the more texts there are the more copies: up to GAIN times the chance level
        times = min(max(np.log10(max(r.most / REPEATS, 1)), 1.0), GAIN)
        sure |= (F.col("what") == what) & (F.col("fold") == fold) & (gain[0] + gain[1] > float((np.log(r.n) + 1) * times))
    return counts.filter(sure)


#: Distinct pairs that one bucket of context_counts() holds about, and after how many a task sends what it has.
BUCKET_PAIRS, SENT_PAIRS = 1 << 20, 1 << 21


def _thin(h: np.ndarray) -> bytes:
    """Sorted hashes as their differences, each in as few bytes as the largest takes; the first byte says how many."""
    steps = np.diff(h, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(h) else 1
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _thick(b: bytes) -> np.ndarray:
    width = b[0]
    steps = np.zeros(((len(b) - 1) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(b, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _one_each(at: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (at, pair) once, sorted by pair."""
    order = np.lexsort((at, pair))
    at, pair = at[order], pair[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (pair[1:] != pair[:-1])
    return at[new], pair[new]


def context_counts(docs: DataFrame, words: np.ndarray, stems: np.ndarray, text_col: str = "text", bucket_pairs: int = BUCKET_PAIRS) -> tuple[np.ndarray, np.ndarray, int]:
    """Of all texts the exact numbers of different words before each of words and of stems (sorted hashes), and before any stem.

    A pair is known by its hash. Tasks make their pairs distinct and send them sorted, in buckets by the first
    bits of the hash; a bucket holds about bucket_pairs pairs whatever the corpus, and no word is hot, as its pairs are in all buckets.
    """
    wanted = docs.sparkSession.sparkContext.broadcast((Lookup(words), Lookup(stems)))
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = int(np.log2(max(n_bytes // 6 // bucket_pairs, 64)))  # a word has some six bytes
    n_own = len(words) + len(stems)
    low = [np.uint64(k << (64 - bits)) for k in range(1 << bits)]

    def sent(every: list, own: list):
        every = np.unique(np.concatenate(every))
        at, pair = _one_each(*(np.concatenate(x) for x in zip(*own, strict=True)))
        cuts, own_cuts = (np.append(np.searchsorted(x, low), len(x)).tolist() for x in (every, pair))
        rows = [k for k in range(1 << bits) if cuts[k] < cuts[k + 1]]  # own pairs stand among every stem's or are words'
        rows += [k for k in range(1 << bits) if cuts[k] == cuts[k + 1] and own_cuts[k] < own_cuts[k + 1]]
        parts = [(k, slice(cuts[k], cuts[k + 1]), slice(own_cuts[k], own_cuts[k + 1])) for k in rows]
        columns = [pa.array([k for k, _, _ in parts], pa.int64()), pa.array([_thin(every[e] - low[k]) for k, e, _ in parts], pa.binary()), pa.array([_thin(pair[o] - low[k]) for k, _, o in parts], pa.binary()), pa.array([at[o].astype(np.int32).tobytes() for _, _, o in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "every", "pair", "at"])

    def run(batches):
        own_words, own_stems = wanted.value
        every, own, n = [], [], 0
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                w, s, before, _ = _tokens(data, offsets)
                of_word, of_stem = own_words(w), own_stems(s)
                some, few = np.flatnonzero(of_word < len(own_words.keys)), np.flatnonzero(of_stem < len(own_stems.keys))
                stem_pair = _pair(before, s)
                every.append(np.unique(stem_pair))
                own.append(_one_each(np.concatenate([of_word[some], len(own_words.keys) + of_stem[few]]), np.concatenate([_pair(before[some], w[some]), stem_pair[few]])))
                n += len(every[-1]) + len(own[-1][0])
                if n > SENT_PAIRS:
                    yield sent(every, own)
                    every, own, n = [], [], 0
        if n:
            yield sent(every, own)

    def count(_, rows):
        every = [_thick(x) for x in rows.column("every").to_pylist()]
        pair = [_thick(x) for x in rows.column("pair").to_pylist()]
        at = [np.frombuffer(x, np.int32) for x in rows.column("at").to_pylist()]
        own, n = np.unique(_one_each(np.concatenate(at), np.concatenate(pair))[0], return_counts=True)
        return pa.table({"at": pa.array(np.append(own, n_own), pa.int64()), "n": pa.array(np.append(n, len(np.unique(np.concatenate(every)))), pa.int64())})

    buckets = docs.select(text_col).mapInArrow(released(run), "bucket long, every binary, pair binary, at binary")
    counted = buckets.groupBy("bucket").applyInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession):
        found = dict(map(tuple, counted.collect()))  # one row for each of words and stems
    wanted.destroy()
    n = np.array([found.get(k, 0) for k in range(n_own)], float)
    return n[: len(words)], n[len(words) :], int(found.get(n_own, 0))


class Lookup:
    """Places of hashes among sorted keys; of any other hash, the number of keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.some = np.zeros(1 << 16, bool)
        self.some[keys >> np.uint64(48)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), len(self.keys))
        maybe = np.flatnonzero(self.some[h >> np.uint64(48)])
        at = np.searchsorted(self.keys, h[maybe])
        same = self.keys[np.minimum(at, len(self.keys) - 1)] == h[maybe] if len(self.keys) else np.zeros(0, bool)
        out[maybe[same]] = at[same]
        return out


class Model:
    """Log-likelihood ratios of toxic over ordinary, of each word of a text.

    sure: told-apart rows of one fold, by what: (at, before, counts of both classes); sizes: for each of the
    classes the sum of word counts; word_of_pair, stem_of: what the shared counts are known for.
    """

    def __init__(self, sure: dict, sizes, words: np.ndarray, word_contexts: np.ndarray, stem_of: np.ndarray, stems: np.ndarray, stem_contexts: np.ndarray, contexts: int, before_counts: list[np.ndarray]):
        self.words, self.stems = Lookup(words), Lookup(stems)
        at, before_of, pairs = sure[PAIRS]
        order = np.argsort(at)
        self.pairs = Lookup(at[order])
        own_stem = np.append(np.searchsorted(stems, stem_of), len(stems))
        stem_contexts = np.append(np.maximum(stem_contexts, 1), 1)  # where nothing is known both classes have it alike, and it cancels
        self.share = np.append(np.maximum(word_contexts, 1), 1) / stem_contexts[own_stem]
        self.share[-1] = 1
        contexts_of, place = np.unique(before_of, return_inverse=True)
        self.contexts = Lookup(contexts_of)
        self.classes = []
        for label in (0, 1):
            own = []
            for what, keys in ((WORDS, words), (STEMS, stems)):
                x = np.zeros(len(keys) + 1)
                x[np.searchsorted(keys, sure[what][0])] = np.maximum(sure[what][2][label] - DISCOUNT, 0)
                own.append(x)
            n_all = max(sizes[label], 1.0)
            stem_p = own[1] / n_all + max(n_all - own[1].sum(), 1) / n_all * stem_contexts / max(contexts, 1)
            back = max(n_all - own[0].sum(), 1) / n_all
            kept = np.maximum(pairs[label] - DISCOUNT, 0) / np.maximum(before_counts[label], 1)
            left = 1 - np.bincount(place, kept, len(contexts_of))  # the discounted mass, which backs off
            self.classes.append((stem_p * back, own[0] / n_all, np.append(kept[order], 0), np.append(left, 1)))

    def ratios(self, words, stems, before) -> np.ndarray:
        w, s, p, c = self.words(words), self.stems(stems), self.pairs(_pair(before, words)), self.contexts(before)
        hit = np.flatnonzero((w < len(self.words.keys)) | (s < len(self.stems.keys)) | (c < len(self.contexts.keys)))

        def ratio(w, s, p, c):
            logs = [np.log(pair_p[p] + left[c] * (word_p[w] + stem_p[s] * self.share[w])) for stem_p, word_p, pair_p, left in self.classes]
            return logs[1] - logs[0]

        out = np.full(len(words), ratio(-1, -1, -1, -1))
        out[hit] = ratio(w[hit], s[hit], p[hit], c[hit])
        return out

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text: length-normalised log-likelihood ratio, the same times the root of its length, of its strongest passage, logarithm of its length."""
        words, stems, before, first = _tokens(data, offsets)
        sums = np.concatenate([[0.0], np.cumsum(self.ratios(words, stems, before))])
        n = np.diff(first)
        total = sums[first[1:]] - sums[first[:-1]]
        out = np.zeros((len(n), 4))
        out[:, 0] = total / np.maximum(n, 1)
        out[:, 1] = total / np.sqrt(np.maximum(n, 1))
        out[:, 3] = np.log1p(n)
        for i in np.flatnonzero(n):
            s = sums[first[i] : first[i + 1] + 1]
            k = min(PASSAGE, n[i])
            out[i, 2] = (s[k:] - s[:-k]).max() / np.sqrt(k)
        return out


def fitted_models(docs: DataFrame, labelled: DataFrame, text_col: str) -> tuple[Model, Model]:
    """The models of both folds. labelled: text, label + 2 * fold."""
    spark = docs.sparkSession
    counts = written(class_counts(labelled), "class-expressions")
    sizes = {(r.what, r.fold): r for r in counts.groupBy("what", "fold").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.count("*").alias("n"), F.max("toxic").alias("most")).collect()}
    sure = [x.to_numpy() for x in told_apart(counts, sizes).toArrow().columns]  # bounded by the labelled texts
    what, fold = sure[:2]
    at, stem, before = (x.view(np.uint64) for x in sure[2:5])
    # what the told-apart expressions rest on: each pair's word, each word's stem
    word = np.where(what == PAIRS, _pair(before, at), at)[what != STEMS]
    words, place = np.unique(word, return_index=True)
    stem_of = stem[what != STEMS][place]
    stems = np.unique(np.concatenate([stem_of, at[what == STEMS]]))
    word_contexts, stem_contexts, contexts = context_counts(docs, words, stems, text_col)
    keys = spark.createDataFrame([(int(x),) for x in np.unique(before[what == PAIRS]).view(np.int64)], "before long")
    # of the words before told-apart pairs, how many pairs they begin
    of_context = {(r.fold, r.before): (r.ordinary, r.toxic) for r in counts.filter(F.col("what") == PAIRS).join(F.broadcast(keys), "before").groupBy("fold", "before").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).collect()}
    models = []
    for f in (0, 1):
        own = {k: (at[m], before[m], [x[m].astype(float) for x in sure[5:]]) for k in (WORDS, STEMS, PAIRS) for m in [(what == k) & (fold == f)]}
        before_counts = np.array([of_context.get((f, x), (0, 0)) for x in own[PAIRS][1].view(np.int64).tolist()], float).reshape(-1, 2).T
        size = sizes.get((WORDS, f))
        models.append(Model(own, (size.ordinary, size.toxic) if size else (0, 0), words, word_contexts, stem_of, stems, stem_contexts, contexts, list(before_counts)))
    discard(counts)
    return tuple(models)


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the last one constant) of a ridge logistic curve, its constant set to the prior share of ones."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.5] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    share = y.mean()
    w[-1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return centre, scale, w


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, threshold: float = 0.7, keep: list[str] = ()) -> DataFrame:
    """id_col, the columns in keep, score and predicted for every row of docs; labels: id_col, label_col (all of them are learnt from)."""
    spark = docs.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("label"))
    in_class = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    own_columns = [id_col, *keep]
    out_type = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in own_columns) + ", score double, predicted int"
    if len(in_class) < 2:
        return docs.select(*own_columns, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sample = []
    for label in (0, 1):
        sample += [(r[0], label) for r in known.filter(F.col("label") == label).orderBy(F.xxhash64(id_col), id_col).limit(max_labelled).select(id_col).collect()]
    seen = [0, 0]
    label_of = {}
    for i, label in sample:  # folds alternate within each class; the order is a hash's
        label_of[i] = label | (seen[label] % 2) << 1
        seen[label] += 1
    own = spark.createDataFrame([(i, x) for i, x in label_of.items()], f"__known {dict(docs.dtypes)[id_col]}, __label int")
    # own has at most 2 * max_labelled rows, and of texts that share an id one is learnt from, so labelled has no more
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    labelled = texts.join(F.broadcast(own), F.col("__id") == F.col("__known")).groupBy("__known", "__label").agg(F.min("__text").alias("__text")).select("__text", "__label")
    # each labelled text gets its evidence from the model of the other fold
    halves = spark.sparkContext.broadcast(fitted_models(docs, labelled, text_col))

    def calibrate(batches):
        models = halves.value
        for b in batches:
            label = b.column(1).to_numpy()
            parts = []
            for lo, hi, data, offsets in slices(b.column(0)):
                two = [m.evidence(data, offsets) for m in models]
                parts.append(np.where((label[lo:hi] >> 1)[:, None] == 0, two[1], two[0]))
            x = np.concatenate(parts) if parts else np.zeros((0, 4))
            yield pa.RecordBatch.from_arrays([pa.array(label & 1), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(4))], names=["y", "a", "b", "c", "d"])

    fitted = labelled.mapInArrow(released(calibrate), "y int, a double, b double, c double, d double").toArrow()
    y, *x = (c.to_numpy() for c in fitted.columns)
    if len(np.unique(y)) < 2:
        return docs.select(*own_columns, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    curve = _logistic(np.column_stack(x), y, in_class[1] / (in_class[0] + in_class[1]))
    # both halves' evidence, averaged, is distributed as what the curve was fitted on; a model of all counts would be surer than it

    def run(batches):
        models, (centre, scale, w) = halves.value, curve
        for b in batches:
            parts = [(models[0].evidence(data, offsets) + models[1].evidence(data, offsets)) / 2 for _, _, data, offsets in slices(b.column(len(own_columns)))]
            x = np.concatenate(parts) if parts else np.zeros((0, 4))
            p = 1 / (1 + np.exp(-np.clip((x - centre) / scale @ w[:-1] + w[-1], -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*own_columns, "score", "predicted"])

    return docs.select(*own_columns, text_col).mapInArrow(released(run), out_type)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return score(table(spark, sf_dir, "documents"), labels).select("doc_id", held_out().alias("held_out"), "score", "predicted")
