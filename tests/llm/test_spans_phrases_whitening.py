"""Personal data, collocations and whitening held against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from turnloom.llm import collocations, pii, whitening
from turnloom.llm._text import slices

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, spans string, kind int, h long, words string"
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def rows(texts, langs=None):
    return [(i, t, (langs or ["en"] * len(texts))[i], "x", 1, 2, "y") for i, t in enumerate(texts)]


# personal data


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def found(texts) -> list:
    out = [[] for _ in texts]
    for lo, _, data, offsets in slices(pa.array(texts, pa.string())):
        kind, text, start, end, base, _, _ = pii.candidates(data, offsets)
        for i in np.flatnonzero(base):
            out[lo + text[i]].append((pii.KINDS[kind[i]], int(start[i]), int(end[i])))
    return [sorted(x, key=lambda s: (pii.KINDS.index(s[0]), s[1])) for x in out]


def test_base_spans_equal_the_patterns():
    rnd = random.Random(4)
    alphabets = ["0123456789 -.", "a@.b-1 _%+", "+0123 ().-", "é4111111111111111 - ", "0.255256 ", "@a.", "19:af. []()at dot"]
    texts = ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 60))) for a in alphabets for _ in range(700)]
    assert found(texts) == [base_spans(t) for t in texts]


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "1." * 150_000, "a.b@" * 60_000, "+1" * 150_000, "1 " * 150_000, ":" * 100_000])
def test_long_runs_take_linear_time(text):
    assert len(found([text])[0]) < 60_000


def test_reliabilities_equal_rows_one_by_one():
    rnd = np.random.default_rng(0)
    y = rnd.random(4000) < 0.4
    right = np.array([0.97, 0.8, 0.7, 0.9, 0.6, 0.75])
    votes = np.where(rnd.random((4000, 6)) < right, y[:, None], ~y[:, None]).astype(int)
    votes[rnd.random((4000, 6)) < 0.3] = -1
    each = pii.reliabilities(votes, np.ones(4000))
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    counted = pii.reliabilities(patterns, n.astype(float))
    assert abs(each[0] - counted[0]) < 1e-6 and np.abs(each[1] - counted[1]).max() < 1e-6
    assert abs(counted[0] - y.mean()) < 0.05
    assert ((each[2] > 0.5) == y).mean() > 0.93
    told = counted[1][:, 1, 2] / (1 - counted[1][:, 1, 0])  # of what is personal data and voted on, voted for
    assert np.abs(told - right).max() < 0.08


def test_spans_with_and_without_the_classifier(spark):
    cards = [next(c for c in (f"45000000{i:07d}{k}" for k in range(10)) if luhn(c)) for i in range(200)]
    others = ["71" + c[2:-1] + str((int(c[-1]) + 3) % 10) for c in cards]
    people = [f"Tel {i} call +1 (555) 010-{1000 + i:04d} or mail user{i}@mail.example.com from 81.2.69.{i % 250 + 1} and {c}, not {o} x" for i, (c, o) in enumerate(zip(cards, others, strict=True))]
    odd = ["phone of both: +1 (826) 555-4081 190.137.223.204 end", "mail jo.doe [at] example [dot] com now", "cards 7536784127813050 4845168114407329 x", "hash 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 x", "no 9807915762804490 here", "ünï +1 (555) 010-1234", "", None, "a" * 50_000, "x 81.2.69.1 y" * 2000]
    texts = people + odd
    df = spark.createDataFrame(rows(texts) + [(None, "mail a@b.co", None, None, None, None, None)] * 2, DOCS)
    got = pii.personal_data(df, keep=["doc_id"]).collect()
    assert len(got) == len(texts) + 2
    by = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in got}
    base = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in got}
    assert all(base[i] == base_spans(t or "") for i, t in enumerate(texts)) and base[None] == [("email", 5, 11)]
    n = len(people)
    text = odd[0]
    assert ("phone", text.index("+1"), text.index(" 190")) in by[n] and ("ip", text.index("190"), text.index(" end")) in by[n]
    assert ("card", odd[2].index("4845"), odd[2].index(" x")) in by[n + 2]
    assert by[n + 3] == by[n + 4] == by[n + 6] == by[n + 7] == by[n + 8] == [] and by[n + 5] == [("phone", 4, 21)]
    for spans in by.values():
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))
    assert pii.personal_data(df.filter("false"), keep=["doc_id"]).collect() == []
    assert [len(r.spans) for r in pii.personal_data(df.filter("doc_id = 206"), keep=["doc_id"]).collect()] == [0]


def test_query_digests_the_base_spans(spark):
    texts = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    got = {r.doc_id: r for r in pii.op11_pii(spark, SF).collect()}
    assert set(got) == set(texts.index)
    for i, text in texts.items():
        base, r = base_spans(text), got[i]
        shown = [f"{k}:{a}:{b}" for k, a, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and set(shown) <= set(r.spans.split(",")) | {""}


# collocations


def plain_collocations(texts, langs, least, top, most_words=4):
    f, n = Counter(), Counter()
    lower = {i: i + 32 for i in range(65, 91)}
    for text, lang in zip(texts, langs, strict=True):
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, most_words + 1) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = Counter()
    for p, a in candidates.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                q = (p[0], *p[i : i + k])
                inside[q] = max(inside[q], a)
    out = {}
    for p, a in candidates.items():
        if 100 * inside[p] < 80 * a:
            score, k = min((2_000_000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, own in out.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top]))


def ordered(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("parts", "top"), [(4096, 1000), (2, 1000), (10**9, 1000), (40, 5)])
def test_collocations_equal_a_plain_version(spark, parts, top):
    """parts=2: hardly any prefix is dealt over tasks; 10**9: every prefix is."""
    rnd = random.Random(parts)
    words = ["the", "of", "New", "York", "city", "en", "de", "é", "日本", "x-y", "a"]
    texts, langs = [], []
    for _ in range(300):
        texts.append("".join(rnd.choices(words, weights=[9, 6, 4, 4, 3, 2, 2, 1, 1, 1, 1])[0] + rnd.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "! "]) for _ in range(rnd.randint(0, 40))))
        langs.append(rnd.choice(["en", "de", None, "und", "", "en", "en"]))
    texts += ["of the city of the city", None, "", "q r s t u " * 40, "q r s t u " * 40] + ["q r s t"] * 9
    langs += ["en", "en", "xx", "en", "en"] + ["en"] * 9
    got = collocations.collocations(spark.createDataFrame(rows(texts, langs), DOCS), least=6, top=top, parts=parts)
    want = plain_collocations(texts, langs, 6, top)
    assert len(want) > (100 if top == 1000 else 10) and ordered(got) == want


def test_collocations_of_nothing(spark):
    assert ordered(collocations.collocations(spark.createDataFrame([], DOCS))) == []
    assert ordered(collocations.collocations(spark.createDataFrame(rows([None, "", "one two three"]), DOCS))) == []


def test_growth_is_depth_first():
    columns = [np.array(c, np.uint64) for c in ([1, 1, 1, 1, 2], [2, 2, 2, 3, 5], [3, 3, 4, 0, 6], [4, 5, 0, 0, 7])]
    n = np.array([2, 3, 4, 1, 9])
    found = collocations.grow(columns, n, 3, np.ones(5, bool))
    assert [(k, f) for k, _, f in found] == [(2, 9), (3, 5), (4, 3), (3, 4), (2, 9), (3, 9), (4, 9)]
    assert len(collocations.grow(columns, n, 3, np.zeros(5, bool))) > len(found)


# whitening


def exact(vectors):
    """x, sums and deviations by fractions."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    return n, s, x, [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]


def test_whitening_equals_lapack_over_fractions(spark):
    rnd = np.random.default_rng(1)
    vectors = (rnd.normal(size=(300, 7)) * [5, 1, 3, 0.5, 2, 8, 0] + [0, 9, -4, 0, 1, 100, 3]).tolist()
    bad = [None, [None] * 7, [float("nan")] + [0.0] * 6, [float("inf")] + [0.0] * 6, [1.0] * 6, [], [1e300] * 7]
    rows = [(i, v, "n", 0, None) for i, v in enumerate(vectors)] + [(None, vectors[0], "n", 0, None), (5, vectors[5], "n", 0, None)] + [(900 + i, v, "n", 0, None) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, component int, c0 string").repartition(3)
    got = whitening.whiten(df, most=4).collect()
    vectors += [vectors[0], vectors[5]]
    n, s, x, deviations = exact(vectors)
    centred = [[Fraction(n * c - t, n) for c, t in zip(v, s, strict=True)] for v in x]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(7)] for i in range(7)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 4 * n and {r.component for r in got} == {1, 2, 3, 4} and {r.n for r in got} == {n}
    of = {}
    for r in got:
        of.setdefault((r.vec_id, r.component), []).append(r)
    ids = list(range(300)) + [None, 5]
    for k in range(4):
        w = np.array(centred, float) @ u[:, k] / np.sqrt(e[k])
        mine = np.array([of[i, k + 1][0].whitened for i in ids])
        assert min(np.abs(mine - w).max(), np.abs(mine + w).max()) < 1e-9
        assert all(abs(r.explained - e[k] / np.trace(v)) < 1e-12 for r in of[3, k + 1])
    assert all(of[i, 1][0].deviation == d for i, d in zip(ids, deviations, strict=True)) and len(of[5, 1]) == 2
    assert max(r.identity_error for r in got) < 1e-10


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9), r.explained) for r in got) == [(1, 1, 128**2, 1.0, 1.0), (2, 1, 128**2, 1.0, 1.0)]


def test_deviations_beyond_a_word():
    steps = np.array([[1.0, -2.0], [3e9, 5.0], [4e12, 0.0]])
    n, s = 7, [5, -3]
    want = [sum((n * int(x) - t) ** 2 for x, t in zip(row, s, strict=True)) for row in steps]
    got = whitening._deviations(steps, n, s, [0, 0]).to_pylist()
    assert got == [w if w < 1 << 63 else None for w in want] and got[2] is None


def test_upper_triangle_is_one_row_of_sums(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (0.5, -1.0, 2.0)], "c0 double, c1 double, c2 double")
    x = np.array([[1.0, 2.0, 3.0], [0.5, -1.0, 2.0]])
    assert np.allclose(whitening.centred_products(df, 3), x.T @ x)
    assert all(whitening.centred_products(df.filter("false"), 3)[i, j] == 0 for i, j in itertools.product(range(3), repeat=2))
