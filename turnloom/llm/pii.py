"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Candidates of a kind (email, ip, card, phone) are the spans of its fixed pattern, those that the pattern matches but that
fail its check, and looser spellings that overlap none of the pattern's: numbers without a plus sign, dotted card numbers,
addresses with "[at]", IPv6, and numbers that stand beside others in a match that fails as a whole. LABELERS vote on each for
personal data, against, or not at all: the kind's own check, the usual grouping, gazetteers (issuers' and calling codes, reserved networks, top-level domains), words before the span, its
edges, and other personal data in the text.

Over all texts the candidates are counted by kind, votes and features; there are finitely many such combinations, so
their number doesn't grow with the corpus. On the counts expectation-maximisation estimates, for each kind,
how often it is personal data and what each labeler votes if it is and if it isn't (its reliability). A logistic classifier on
the features is fitted to the posteriors, weighted by the counts. A second pass over the texts applies it;
texts are never moved. What the fixed pattern finds stays whatever the classifier says; other candidates
are added from THRESHOLD on if they overlap nothing found before, the likelier first. A span that fails its kind's own check
is none, however it is spelt.

All patterns are matched by runs of character classes, so the time is linear in the text however it is built.

Defined results: null and empty texts have no spans; a span doesn't cross texts; repeated rows and null ids get their
spans each; without candidates nothing is fitted and nothing added; an empty table gives an empty result; other columns aren't read.
"""

import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import table
from ._text import released, slices

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("check", "grouping", "gazetteer", "words", "edges", "company")
#: Numbers of values of the features: digits, separators, character before and after, words, grouping, gazetteer, check, looser spelling, company.
FEATURES = (8, 5, 6, 6, 3, 3, 3, 3, 2, 2)
THRESHOLD = 0.9
#: Bytes before a span in which words are looked for.
REACH = 48

# Gazetteers: fixed values.
DOMAINS = frozenset("com org net edu gov mil int info biz name io eu uk de fr es it nl be at ch pt pl se no dk fi ie gr cz hu ro us ca mx br ar cl co au nz jp cn kr in ru tr za".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 852 886 961 962 963 964 965 966 971 972 974".split())
#: First digits of card numbers and the numbers of digits that go with them.
ISSUERS = ((("4",), (13, 16, 19)), (tuple(str(k) for k in range(51, 56)), (16,)), (tuple(str(k) for k in range(2221, 2721)), (16,)), (("34", "37"), (15,)), (("6011", "65"), (16, 19)), (("36", "38", "30"), (14,)), (("35",), (16,)))
WORDS = (
    re.compile(rb"\b(?:e-?mail|mail|contact|kontakt|contacto|courriel|correo)\b"),
    re.compile(rb"\b(?:ip|host|server|login|client|address|adresse|servidor|serveur)\b"),
    re.compile(rb"\b(?:card|visa|mastercard|credit|debit|karte|kreditkarte|carte|tarjeta|payment)\b"),
    re.compile(rb"\b(?:tel|phone|telephone|call|mobile|cell|fax|telefon|anruf|handy|portable|movil|llamar)\b|t\xc3\xa9l\xc3\xa9phone|tel\xc3\xa9fono|m\xc3\xb3vil"),
)
AGAINST = re.compile(rb"\b(?:order|isbn|issn|version|build|sha|sha1|sha256|md5|hash|token|key|serial|invoice|ref|sku|id|timestamp)\b")
_AT = re.compile(rb"([A-Za-z0-9._%+-]{1,64}) ?[\[({] ?at ?[\])}] ?([A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[A-Za-z0-9-]{1,63}){1,8})", re.I)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGITS, _LETTERS = b"0123456789", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGIT, LABEL, LOCAL = _class(_DIGITS), _class(_DIGITS + _LETTERS + b"-"), _class(_DIGITS + _LETTERS + b"._%+-")
DIALLED, DIALLED_LOOSE, HEX = _class(_DIGITS + b" ().-"), _class(_DIGITS + b" ().-/"), _class(b"0123456789abcdefABCDEF:")
#: Classes of a neighbouring character: blank or none, letter, digit, assignment, quote or bracket, any other.
NEIGHBOUR = np.full(256, 5, np.int8)
for _k, _chars in enumerate((b"\x00 \t\n\r\x0b\x0c", _LETTERS + bytes(range(128, 256)), _DIGITS, b"=:#/\\_@&", b"\"'()[]{}<>")):
    NEIGHBOUR[list(_chars)] = _k


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _chains(link: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each chain of n runs, where link tells whether a run goes on in the next."""
    first = np.flatnonzero(np.concatenate([[True], ~link])) if n else np.zeros(0, np.int64)
    return first, np.append(first[1:] - 1, n - 1) if n else first


class Texts:
    """Texts with a zero byte before, between and after them, so that no run crosses from one to the next."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        self.data = np.zeros(len(data) + n + 8, np.uint8)
        self.data[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = data
        self.starts = offsets[:-1] + np.arange(1, n + 1)
        self.digit = DIGIT[self.data]
        self.digits = np.flatnonzero(self.digit)
        self.ds, self.de = _runs(self.digit)
        self.before = np.concatenate([[0], np.cumsum(self.de - self.ds)])  # digits before each run

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def characters(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Characters of the text before byte `at`."""
        if not hasattr(self, "chars"):
            self.chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return self.chars[at] - self.chars[self.starts[text]]

    def linked(self, separators: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Chains of digit runs with one of the separators between two."""
        link = (self.ds[1:] - self.de[:-1] == 1) & _class(separators)[self.data[self.de[:-1]]]
        return _chains(link, len(self.ds))

    def luhn(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n digits, from the first-th of all digits on, pass Luhn's check."""
        if not len(first):
            return np.zeros(0, bool)
        k = np.arange(int(n.max()))[None, :]
        d = np.where(k < n[:, None], self.data[self.digits[np.maximum((first + n - 1)[:, None] - k, 0)]].astype(np.int64) - 48, 0)
        d = np.where(k % 2 == 1, d * 2 - 9 * (d > 4), d)
        return d.sum(axis=1) % 10 == 0


def _cards(t: Texts):
    """(start, end, passes, looser spelling) of numbers of 13 to 19 digits."""
    for separators, loose in ((b" -", False), (b" -./_", True)):
        a, b = t.linked(separators)
        n = t.before[b + 1] - t.before[a]
        if loose:  # only those with a separator that the pattern hasn't
            odd = np.concatenate([[0], np.cumsum(_class(b"./_")[t.data[t.de]])]) if len(t.de) else np.zeros(1, np.int64)
            at = (n >= 13) & (n <= 19) & (odd[b] > odd[a])
        else:
            at = (n >= 13) & (n <= 19)
        longer = np.flatnonzero(n > 19)
        a, b, n = a[at], b[at], n[at]
        yield t.ds[a], t.de[b], t.luhn(t.before[a], n), loose
        if not loose:  # whole numbers among others
            first, last = t.linked(separators)
            part = np.flatnonzero((t.de - t.ds >= 13) & (t.de - t.ds <= 19))
            part = part[np.isin(np.searchsorted(first, part, "right") - 1, longer)]
            yield t.ds[part], t.de[part], t.luhn(t.before[part], (t.de - t.ds)[part]), True


def _ips(t: Texts):
    """(start, end, passes) of four numbers with dots."""
    a, b = t.linked(b".")
    groups = (b - a + 1) // 4
    first = np.repeat(a, groups) + 4 * (np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups))
    if not len(first):
        return first, first, np.zeros(0, bool)
    length = t.de - t.ds
    digit = lambda k: np.where(length > k, t.data[np.maximum(t.de - 1 - k, 0)].astype(np.int64) - 48, 0)
    small = digit(0) + 10 * digit(1) + 100 * digit(2) <= 255
    other = np.concatenate([[0], np.cumsum(t.digit & (t.data != 48))])
    small &= other[np.maximum(t.de - 3, t.ds)] == other[t.ds]  # zeros only before the last three
    return t.ds[first], t.de[first + 3], small[first] & small[first + 1] & small[first + 2] & small[first + 3]


def _phones(t: Texts):
    """(start, end, passes) of numbers with a plus sign."""
    plus = np.flatnonzero((t.data[:-1] == 43) & t.digit[1:])
    if not len(plus):
        return plus, plus, np.zeros(0, bool)
    _, ends = _runs(DIALLED[t.data])
    end = ends[np.searchsorted(ends, plus + 1, "right")]
    last = np.searchsorted(t.digits, end) - 1
    n = last - np.searchsorted(t.digits, plus + 1) + 1
    end = t.digits[last] + 1
    at = end - plus >= 4
    return plus[at], end[at], ((n >= 9) & (n <= 15))[at]


def _phone_parts(t: Texts, start: np.ndarray, end: np.ndarray):
    """Of numbers with a plus sign that have too many digits, what stands before the first blank after nine digits or more."""
    out = []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        n = 0
        for k, c in enumerate(t.data[a : min(b, a + 64)].tolist()):
            n += 48 <= c <= 57
            if n >= 9 and c == 32 and 48 <= t.data[a + k - 1] <= 57:
                if n <= 15:
                    out.append((a, a + k))
                break
    return tuple(np.array([x[k] for x in out], np.int64) for k in (0, 1))


def _loose_phones(t: Texts):
    starts, ends = _runs(DIALLED_LOOSE[t.data])
    a, b = np.searchsorted(t.digits, starts), np.searchsorted(t.digits, ends)
    at = np.flatnonzero((b - a >= 9) & (b - a <= 15))
    if not len(at):
        return at, at
    start, end = t.digits[a[at]], t.digits[b[at] - 1] + 1
    signed = t.data[start - 1] == 43
    start = start - (t.data[start - 1] == 40)  # (
    return start[~signed], end[~signed]


def _emails(t: Texts):
    """(start, end, has a domain) of addresses."""
    at = np.flatnonzero(t.data == 64)
    if not len(at):
        return at, at, np.zeros(0, bool)
    ls, le = _runs(LOCAL[t.data])
    bs, be = _runs(LABEL[t.data])
    if not len(ls) or not len(bs):
        return at[:0], at[:0], np.zeros(0, bool)
    link = (bs[1:] - be[:-1] == 1) & (t.data[be[:-1]] == 46)
    first, last = _chains(link, len(bs))
    own, domain = np.minimum(np.searchsorted(le, at), len(le) - 1), np.minimum(np.searchsorted(bs, at + 1), len(bs) - 1)
    chain_end = last[np.searchsorted(first, domain, "right") - 1]
    named, begins = le[own] == at, bs[domain] == at + 1
    out, reached = [], 0
    for p, start, has_name, has_domain, parts, end in zip(at.tolist(), ls[own].tolist(), named.tolist(), begins.tolist(), (chain_end - domain + 1).tolist(), be[chain_end].tolist(), strict=True):
        start = max(start, reached)
        if has_name and start < p and has_domain:
            out.append((start, end, parts > 1))
            if parts > 1:
                reached = end
    return tuple(np.array(x, k) for x, k in zip(zip(*out, strict=True) if out else ((), (), ()), (np.int64, np.int64, bool), strict=True))


def _spelt_emails(t: Texts) -> list[tuple[int, int]]:
    """Addresses with at in brackets."""
    low = t.data | 32
    at = np.flatnonzero((low[:-1] == ord("a")) & (low[1:] == ord("t")) & np.isin(np.concatenate([[0], t.data[:-2]]), list(b"[({ ")) & np.isin(np.append(t.data[2:], 0), list(b"])} ")))
    out, reached = [], 0
    if not len(at):
        return out
    bracket = np.isin(t.data[at - 1], list(b"[({")) | np.isin(t.data[at - 2], list(b"[({"))
    for p in at[bracket].tolist():
        lo = max(p - 70, reached, 0)
        m = next((m for m in _AT.finditer(t.data[lo : p + 200].tobytes()) if m.start() + lo < p < m.end() + lo), None)
        if m:
            out.append((m.start() + lo, m.end() + lo))
            reached = m.end() + lo
    return out


def _ipv6(t: Texts) -> list[tuple[int, int, bool]]:
    starts, ends = _runs(HEX[t.data])
    colons = np.concatenate([[0], np.cumsum(t.data == 58)])
    at = (colons[ends] - colons[starts] >= 3) & (ends - starts <= 39)
    out = []
    for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True):
        try:
            ipaddress.IPv6Address(t.data[a:b].tobytes().decode())
            out.append((a, b, True))
        except ValueError:
            out.append((a, b, False))
    return out


def _grouping(kind: int, span: bytes) -> int:
    parts = [len(x) for x in re.findall(rb"\d+", span)]
    if kind == EMAIL:
        return int(bool(re.search(rb"[A-Za-z]{2,10}$", span)))
    if kind == IP:
        return int(b":" in span or not re.search(rb"(?:^|\.)0\d", span))
    if kind == CARD:
        return int(parts in ([4] * 4, [4, 6, 5], [4, 6, 4]) or len(parts) == 1 and parts[0] in (15, 16))
    return int(len(parts) > 1 and max(parts) <= 8 and parts[-1] >= 2)


def _gazetteer(kind: int, span: bytes) -> int:
    digits = re.sub(rb"\D", b"", span).decode()
    if kind == EMAIL:
        return 1 if re.search(rb"[A-Za-z0-9-]*$", span)[0].decode().lower() in DOMAINS else -1
    if kind == IP:
        try:
            address = ipaddress.ip_address(".".join(str(int(x)) for x in span.decode().split(".")) if b"." in span else span.decode())
        except ValueError:
            return 0
        return int(address.is_global)
    if kind == CARD:
        return int(any(len(digits) in lengths and digits.startswith(starts) for starts, lengths in ISSUERS))
    if span[:1] == b"+":
        return int(any(digits[:k] in CALLING_CODES for k in (1, 2, 3)))
    return -1


#: Which character classes at a span's edges speak against it.
GLUED = np.array([False, True, True, True, False, False])


def candidates(data: np.ndarray, offsets: np.ndarray):
    """kind, text, start, end (characters), base (found by the fixed pattern), votes and features of each candidate, as arrays; columns of votes: LABELERS, -1 where one abstains."""
    t = Texts(data, offsets)
    found = []  # kind, starts, ends, passes, loose
    a, b, ok = _emails(t)
    found.append((EMAIL, a, b, ok.astype(np.int8), False))
    spelt = _spelt_emails(t)
    found.append((EMAIL, *(np.array([x[k] for x in spelt], np.int64) for k in (0, 1)), np.full(len(spelt), -1, np.int8), True))
    a, b, ok = _ips(t)
    found.append((IP, a, b, ok.astype(np.int8), False))
    six = _ipv6(t)
    found.append((IP, *(np.array([x[k] for x in six], np.int64) for k in (0, 1)), np.array([x[2] for x in six], np.int8), True))
    for a, b, ok, loose in _cards(t):
        found.append((CARD, a, b, ok.astype(np.int8), loose))
    a, b, ok = _phones(t)
    found.append((PHONE, a, b, ok.astype(np.int8), False))
    a, b = _phone_parts(t, a[~ok], b[~ok])
    found.append((PHONE, a, b, np.ones(len(a), np.int8), True))
    a, b = _loose_phones(t)
    found.append((PHONE, a, b, np.full(len(a), -1, np.int8), True))

    kind = np.concatenate([np.full(len(f[1]), f[0], np.int8) for f in found])
    a, b, passes = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
    loose = np.concatenate([np.full(len(f[1]), f[4]) for f in found])
    base = ~loose & (passes == 1)
    own, ends = np.sort(a[base]), np.maximum.accumulate(b[base][np.argsort(a[base], kind="stable")])
    # of looser spellings those that overlap nothing found by a pattern: what begins before they end ends before they begin
    before = np.searchsorted(own, b) - 1
    free = ~loose | (before < 0) | (ends[np.maximum(before, 0)] <= a) if len(own) else np.ones(len(a), bool)
    kind, a, b, passes, loose, base = (x[free] for x in (kind, a, b, passes, loose, base))
    text = t.text_of(a)
    in_text = np.zeros((len(t.starts), len(KINDS)), bool)
    in_text[text[base], kind[base]] = True
    others = in_text[text].sum(axis=1) - in_text[text, kind] if len(kind) else np.zeros(0, np.int64)
    left, right = NEIGHBOUR[t.data[a - 1]], NEIGHBOUR[t.data[b]]
    n_digits = np.searchsorted(t.digits, b) - np.searchsorted(t.digits, a)
    votes, separators = np.full((len(kind), len(LABELERS)), -1, np.int8), np.zeros(len(kind), np.int64)
    votes[:, 0] = passes
    votes[:, 4] = ~(GLUED[left] | GLUED[right])
    votes[:, 5] = np.where(others > 0, 1, -1)
    begins = t.starts[text]
    for i, (k, lo, hi, begin) in enumerate(zip(kind.tolist(), a.tolist(), b.tolist(), begins.tolist(), strict=True)):
        span, said = t.data[lo:hi].tobytes(), t.data[max(begin, lo - REACH) : lo].tobytes().lower()
        votes[i, 1], votes[i, 2] = _grouping(k, span), _gazetteer(k, span)
        pro, contra = WORDS[k].search(said), AGAINST.search(said)
        votes[i, 3] = -1 if bool(pro) == bool(contra) else int(bool(pro))
        separators[i] = len(re.findall(rb"[^0-9A-Za-z]+", span))
    features = np.column_stack([np.minimum(n_digits // 3, 7), np.minimum(separators, 4), left, right, votes[:, 3] + 1, votes[:, 1] + 1, votes[:, 2] + 1, passes + 1, loose, others > 0]).astype(np.int8)
    return kind, text, t.characters(text, a), t.characters(text, b), base, votes, features


def _packed(x: np.ndarray, sizes) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k, size in enumerate(sizes):
        out = out * size + x[:, k]
    return out


def _unpacked(code: np.ndarray, sizes) -> np.ndarray:
    out = np.zeros((len(code), len(sizes)), np.int64)
    for k in range(len(sizes) - 1, -1, -1):
        out[:, k] = code % sizes[k]
        code = code // sizes[k]
    return out


def patterns(texts: DataFrame) -> DataFrame:
    """kind, votes, features (packed) and n, the number of such candidates in all texts. texts: one column."""

    def run(batches):
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                kind, _, _, _, _, votes, features = candidates(data, offsets)
                rows, n = np.unique(np.column_stack([kind, _packed(votes + 1, [3] * len(LABELERS)), _packed(features, FEATURES)]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, k]).astype(np.int64)) for k in range(3)), pa.array(n)], names=["kind", "votes", "features", "n"])

    return texts.mapInArrow(released(run), "kind long, votes long, features long, n long").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))


#: Pseudo-counts of a labeler's votes (abstains, against, for) of what is no personal data and of what is: right more often than not.
PRIOR = np.array([[2.0, 4.0, 1.0], [2.0, 1.0, 4.0]])
#: The same of a kind's own check, which hardly errs.
PRIOR_CHECK = np.array([[8.0, 16.0, 0.1], [2.0, 0.1, 16.0]])


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """By expectation-maximisation over vote patterns with counts n: share of personal data, table [labeler, class, vote + 1] of probabilities, posterior of each pattern."""
    prior = np.array([PRIOR_CHECK] + [PRIOR] * (votes.shape[1] - 1))
    rate, told = 0.5, prior / prior.sum(axis=2, keepdims=True)
    one_hot = (votes[:, :, None] + 1 == np.arange(3)).astype(float)
    posterior = np.zeros(len(n))
    for _ in range(rounds):
        logs = np.einsum("plv,lcv->pc", one_hot, np.log(told)) + np.log([1 - rate, rate])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        weights = np.column_stack([(1 - new) * n, new * n])
        counts = np.einsum("plv,pc->lcv", one_hot, weights) + prior
        told = counts / counts.sum(axis=2, keepdims=True)
        rate = float((weights[:, 1].sum() + 1) / (n.sum() + 2))
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
    return rate, told, new


def _one_hot(features: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(size)[features[:, k]] for k, size in enumerate(FEATURES)] + [np.ones((len(features), 1))], axis=1)


def fitted(features: np.ndarray, target: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic curve over one-hot features, fitted to soft targets with counts n."""
    x = _one_hot(features)
    w = np.zeros(x.shape[1])
    n = n / max(n.sum(), 1) * min(n.sum(), 1e6)  # keeps the ridge's weight in proportion
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (target - p)) - w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def classifier(counted) -> dict[int, np.ndarray]:
    """Weights of each kind's span classifier; counted: rows of patterns(), collected."""
    out = {}
    kind, votes, features, n = (np.asarray(c) for c in counted)
    for k in range(len(KINDS)):
        own = kind == k
        if own.any():
            _, _, posterior = reliabilities(_unpacked(votes[own], [3] * len(LABELERS)) - 1, n[own].astype(float))
            out[k] = fitted(_unpacked(features[own], FEATURES), posterior, n[own].astype(float))
    return out


def decided(kind, text, start, end, base, votes, features, weights: dict, threshold: float) -> np.ndarray:
    """Which candidates are spans: all base ones, and the likelier of the others that overlap none."""
    likely = np.zeros(len(kind))
    for k, w in weights.items():
        own = np.flatnonzero((kind == k) & ~base & (votes[:, 0] != 0))
        likely[own] = 1 / (1 + np.exp(-_one_hot(features[own].astype(np.int64)) @ w))
    out = base.copy()
    more = np.flatnonzero(~base & (likely >= threshold))
    if len(more):
        taken: dict[int, list] = {}
        touched = np.isin(text, text[more])
        for i in np.flatnonzero(base & touched).tolist():
            taken.setdefault(int(text[i]), []).append((int(start[i]), int(end[i])))
        for i in sorted(more.tolist(), key=lambda i: (-likely[i], int(start[i]), int(kind[i]))):
            own = taken.setdefault(int(text[i]), [])
            if all(e <= start[i] or s >= end[i] for s, e in own):
                own.append((int(start[i]), int(end[i])))
                out[i] = True
    return out


SPANS = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"


def personal_data(docs: DataFrame, *, text_col: str = "text", keep: list[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """The columns in keep and spans, by kind and start (characters), of every row of docs."""
    weights = classifier(patterns(docs.select(text_col)).toArrow().columns)
    keep = list(keep)
    types = dict(docs.dtypes)
    names = pa.array(KINDS)

    def run(batches):
        for b in batches:
            parts = []
            for lo, _, data, offsets in slices(b.column(len(keep))):
                kind, text, start, end, base, votes, features = candidates(data, offsets)
                at = np.flatnonzero(decided(kind, text, start, end, base, votes, features, weights, threshold))
                parts.append(np.stack([text[at] + lo, kind[at], start[at], end[at], base[at]]).astype(np.int64))
            row, kind, start, end, base = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
            order = np.lexsort((end, start, kind, row))
            bounds = np.searchsorted(row[order], np.arange(b.num_rows + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([names.take(pa.array(kind[order])), pa.array(start[order]), pa.array(end[order]), pa.array(base[order].astype(bool))], names=["kind", "start", "end", "base"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(bounds), values)], names=[*keep, "spans"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"spans {SPANS}"])
    return docs.select(*keep, text_col).mapInArrow(released(run), schema)


def op11_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
