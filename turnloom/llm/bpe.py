"""Byte-level BPE over numpy matrices.

The pieces that the pattern finds are encoded each for itself: distinct unknown pieces of a slice
go into matrices by length, padded; in every round each row merges its leftmost pair of
minimum rank, found by a hashed pair lookup, and the matrix closes up by one column. Rows
without a known pair are done. Ids of frequent pieces are kept in a bounded dictionary, which
changes speed only.

A piece longer than LONG bytes is a matrix of one row, in which a round merges all pairs of the minimum rank, from the
left and none overlapping another, as a round for each merge would be quadratic. That is the same as one after the other,
unless a merged token makes a pair of lower rank than its own; of such tokens, if a vocabulary has any, only the leftmost pair merges.

Defined results: a null or empty text has no ids, and decodes to no bytes; every row is
encoded for itself, repeated ones too; an empty table gives an empty result; other columns of
the input are read only where asked for.
"""

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._store import table
from ._text import released, slices

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
#: Pieces longer than this merge several pairs a round.
LONG = 192
#: Pieces kept with their ids, in each worker.
KEPT_PIECES = 150_000
_NONE = np.int32(1 << 30)


class Vocabulary:
    """Ranks of a tiktoken file, as a table from (left id, right id) to the merged id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                a, b = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        keys, merged = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        if len(self.bytes_of) > 1 << 20:
            raise ValueError("ids have to be below 2**20")
        #: tokens of which a pair merges to a lower rank than their own
        self.early = np.unique(np.concatenate([part[merged < part] for part in (keys >> 20, keys & 0xFFFFF)]))
        self.bits = max(4, int(len(pairs)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, _NONE, np.int32)
        at, left, self.steps = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.steps += 1
            slots = at[left]
            free = self.keys[slots] == -1
            _, winners = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            winners = winners[free[winners]]
            self.keys[slots[winners]], self.merged[slots[winners]] = keys[left[winners]], merged[left[winners]]
            rest = np.ones(len(left), bool)
            rest[winners] = False
            left = left[rest]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs; _NONE where a pair has none. Linear probing."""
        want = (left.astype(np.int64) << 20 | right).ravel()
        want[want < 0] = -2  # padding; no key
        at = self._slot(want)
        have = self.keys[at]
        out = np.where(have == want, self.merged[at], _NONE)
        left = np.flatnonzero((have != want) & (have != -1) & (want >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            have = self.keys[at[left]]
            hit = have == want[left]
            out[left[hit]] = self.merged[at[left[hit]]]
            left = left[~hit & (have != -1)]
        return out.reshape(right.shape)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = [rank]
            elif len(p) > LONG:
                out[i] = self._encode_long(p)
            else:
                by_length.setdefault(len(p) + 3 & ~3, []).append(i)
        for width, rows in by_length.items():
            for at in range(0, len(rows), step := max(1, (1 << 18) // width)):
                part = rows[at : at + step]
                for i, ids in zip(part, self._merge_all([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_all(self, pieces: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(len(pieces), width)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[raw], np.int32(-1))
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(pieces)), [None] * len(pieces)
        while True:
            best = ranks.argmin(axis=1)
            done = ranks[np.arange(len(rows)), best] == _NONE
            if done.any():
                own = ids[done]
                ends = np.cumsum((own >= 0).sum(axis=1)).tolist()
                flat, at = own[own >= 0].tolist(), 0
                for i, end in zip(rows[done].tolist(), ends, strict=True):
                    out[i] = flat[at:end]
                    at = end
                going = ~done
                rows, ids, ranks, best = rows[going], ids[going], ranks[going], best[going]
            if not len(rows):
                return out
            at = np.arange(len(rows))
            ids[at, best] = ranks[at, best]
            stays = np.ones(ids.shape, bool)
            stays[at, best + 1] = False
            ids = ids[stays].reshape(len(rows), -1)
            if ids.shape[1] == 1:
                for i, own in zip(rows.tolist(), ids.tolist(), strict=True):
                    out[i] = own
                return out
            stays = np.ones(ranks.shape, bool)
            stays[at, np.minimum(best + 1, ranks.shape[1] - 1)] = False
            ranks = ranks[stays].reshape(len(rows), -1)
            for pair in (best - 1, best):  # only the merged token's two pairs are new
                ok = np.flatnonzero((pair >= 0) & (pair < ranks.shape[1]))
                ranks[ok, pair[ok]] = self.rank_of(ids[ok, pair[ok]], ids[ok, pair[ok] + 1])

    def _encode_long(self, piece: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.rank_of(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == best)
            if best in self.early:
                at = at[:1]
            else:  # of pairs that overlap, as in aaaa, every second one
                first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
                at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            ids[at] = best
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            new = at - np.arange(len(at))
            for pair in (new - 1, new):  # only the merged tokens' pairs are new
                pair = pair[(pair >= 0) & (pair < len(ranks))]
                ranks[pair] = self.rank_of(ids[pair], ids[pair + 1])
        return ids.tolist()

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


class Splitter:
    """All matches of the pattern. Texts without rare classes of characters take an equal pattern of the re module, which is faster."""

    def __init__(self, pattern: str):
        import regex

        self.exact = regex.compile(pattern)
        self.fast = None
        if pattern == r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
            # re's \d is only decimal digits and its \s has 0x1C to 0x1F, so texts with such characters take the exact pattern
            self.rare = re.compile(r"[\x1c-\x1f\x85÷]|[^\x00-ɏ]|[ª²³¹º¼-¾]")
            self.fast = re.compile(r"""'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")

    def __call__(self, texts: list[str], data: np.ndarray | None = None) -> list[list[str]]:
        """data: the texts' bytes, where at hand; they show at once that no text is rare."""
        if self.fast is None:
            return [self.exact.findall(t) for t in texts]
        # lead bytes 0xC3 to 0xC9 begin U+00C0 to U+024F, all letters but for the two signs of multiplication and division
        if data is not None and not ((data > 0xC9) & (data < 0xFE) | (data == 0xC2) | (data > 0x1B) & (data < 0x20)).any():
            return [self.fast.findall(t) for t in texts]
        return [(self.exact if self.rare.search(t) else self.fast).findall(t) for t in texts]


class Encoder:
    """Whole texts to ids. Keeps the ids of pieces seen, in a dictionary of bounded size."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.split = Vocabulary(path), Splitter(pattern)
        self.id_text = [str(i) for i in range(len(self.vocabulary.bytes_of))]
        self.bytes_of = dict(zip(self.id_text, self.vocabulary.bytes_of, strict=True))
        self.ids_of: dict[str, str] = {}

    def __call__(self, texts: list[str], data: np.ndarray | None = None):
        """For each text its ids, as decimal numbers joined by commas, and the bytes that they decode to."""
        split = self.split(texts, data)
        if len(self.ids_of) > KEPT_PIECES:
            self.ids_of = {}
        new: set[str] = set()
        for pieces in split:
            new.update(pieces)
        new.difference_update(self.ids_of)
        found = self.vocabulary.encode_pieces([p.encode() for p in new])
        for p, ids in zip(new, found, strict=True):
            self.ids_of[p] = ",".join(map(self.id_text.__getitem__, ids))
        for pieces in split:
            ids = ",".join(map(self.ids_of.__getitem__, pieces))
            yield ids, b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN


def _encoder(files: tuple[str, str] | None) -> Encoder:
    return Encoder(*(files or default_files()))


def encode(docs: DataFrame, *, keep: list[str], text_col: str = "text", ids_col: str = "ids", files: tuple[str, str] | None = None) -> DataFrame:
    """Columns `keep` and the ids of the whole text. files: (rank file on every worker, pattern)."""

    def run(batches):
        encoder = _encoder(files)
        for b in batches:
            texts = b.column(len(keep))
            for lo, hi, data, _ in slices(texts):
                ids = [list(map(int, x.split(","))) if x else [] for x, _ in encoder([t or "" for t in texts[lo:hi].to_pylist()], data)]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[: len(keep)]), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, ids_col])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + f", `{ids_col}` array<int>"
    return docs.select(*keep, text_col).mapInArrow(released(run), schema)


def decode(ids: DataFrame, *, keep: list[str], ids_col: str = "ids", text_col: str = "text", files: tuple[str, str] | None = None) -> DataFrame:
    """Columns `keep` and the text of the ids; bytes that aren't UTF-8 become U+FFFD."""

    def run(batches):
        vocabulary = _encoder(files).vocabulary
        for b in batches:
            texts = [vocabulary.decode(x or ()).decode("utf-8", "replace") for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, text_col])

    schema = ", ".join(f"`{c}` {t}" for c, t in ids.select(*keep).dtypes) + f", `{text_col}` string"
    return ids.select(*keep, ids_col).mapInArrow(released(run), schema)


def digests(docs: DataFrame, *, keep: list[str], text_col: str = "text", files: tuple[str, str] | None = None) -> DataFrame:
    """Columns `keep`, n_tokens, and SHA-256 of the ids and of the bytes that they decode to."""

    def run(batches):
        encoder = _encoder(files)
        for b in batches:
            texts = b.column(len(keep))
            for lo, hi, data, _ in slices(texts):
                n, ids_sha, text_sha = [], [], []
                for ids, decoded in encoder([t or "" for t in texts[lo:hi].to_pylist()], data):
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded).hexdigest())
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[: len(keep)]), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(*keep, text_col).mapInArrow(released(run), schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), keep=["doc_id"])
