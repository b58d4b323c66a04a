"""Markup that HTML allows, long pieces, many boundaries, sites by brute force, and paraphrased benchmark items."""

import base64
import math
import random
import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnloom.llm import bpe, decontamination, html_text, sharding, site_quality, suffix_dedup

SF = "/root/testdata/sf0.001"
LONG = "A paragraph of the article with quite enough words to be told from a menu, a notice or an advert by anyone."
TREE = html_text.train()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><head><title>T</title><meta charset=utf-8><body><p>{LONG}</p>", LONG),
        (f"<p>{LONG}</p><svg/><p>{LONG}</p>", f"{LONG}\n\n{LONG}"),
        (f'<div class="content with-sidebar"><p>{LONG}</p></div>', LONG),
        (f'<div class="has-menu no-banner"><p>{LONG}</p></div>', LONG),
        (f'<p>{LONG}</p><p class="ad">Buy this fine thing today, it is very cheap and you will like it.</p><p>{LONG}</p>', f"{LONG}\n\n{LONG}"),
        (f'<article><p>{LONG}</p><ul><li class="comment">I liked to read this very much, thanks to all.<li>{LONG}</ul></article>', f"{LONG}\n\n{LONG}"),
        (f"<h1>Short heading</h1><p>{LONG}</p>", f"Short heading\n\n{LONG}"),
        (f'<ul><li><a href="/a">Home</a><li><a href="/b">All news</a></ul><h1>A title</h1><p>{LONG}</p>', f"A title\n\n{LONG}"),
        (f'<ul><li><a href="/a">Home</a></ul><p>So it began.</p><p>{LONG}</p>', f"So it began.\n\n{LONG}"),
        (f'<table><tr><td class="sidebar"><p>Other things that you may like to read here.<td><p>{LONG}</table>', LONG),
        (f'<p>{LONG} <span class="ad">Buy it now</span> More of what the article has to say.</p>', f"{LONG}\n\nMore of what the article has to say."),
        (f"<select><option>One<p>{LONG}", LONG),
        (f'<article class="post type-post category-legal tag-social hentry"><p>{LONG}</p></article>', LONG), (f'<article id="public-notice-2020"><p>{LONG}</p></article>', LONG), (f'<main class="search-engines"><p>{LONG}</p></main>', LONG),
        (f'<div class="sidebar-right layout"><nav><a>Home</a></nav><article><p>{LONG}</p></article></div>', LONG), (f'<article><p>{LONG}</p><div class="note alert-info">{LONG}</div></article>', f"{LONG}\n\n{LONG}"), (f'<p data-class="ad">{LONG}</p>', LONG),
        (f'<form id="aspnetForm"><article><p>{LONG}</p></article></form>', LONG), (f"<nav><a href=x>Home</a><main><p>{LONG}</p></main>", LONG), (f"<!--><p>{LONG}</p>", LONG), (f"<!--->{LONG}<!-- x --!><p>{LONG}</p>", f"{LONG}\n\n{LONG}"),
        (f"<article><p>{LONG}</p><p><a href=x>A linked line</a></p><p>{LONG}</p></article>", f"{LONG}\n\nA linked line\n\n{LONG}"), (f"<article><p>{LONG}</p><p>And so it ended.</p></article><nav><a>Home</a></nav><ul><li><a>More of it</a></ul>", f"{LONG}\n\nAnd so it ended."),
        (f"<article><p>{LONG}</p><h2>Sources</h2><ul><li><a>A book</a><li><a>A paper of his</a></ul></article>", f"{LONG}\n\nSources\n\nA book\n\nA paper of his"),
        (f'<p title="a > b">{LONG}</p>', LONG), (f'<p>{LONG} <img alt="x > y" src=a></p>', LONG), (f'<p title="open>{LONG}</p>', LONG),
        (f'<div class="header"><p>The site that you are on</p></div><p>{LONG}</p>', LONG), (f'<div id="page-header">The site that you are on</div><p>{LONG}</p>', LONG), (f'<div class="entry-header"><h1>The title</h1></div><p>{LONG}</p>', f"The title\n\n{LONG}"),
        (f'<p>{LONG}</p><ol class="commentlist"><li>{LONG}<li>I liked it.</ol>', LONG), (f'<p>{LONG}</p><div class="siteFooter">All rights are reserved by us</div>', LONG), (f'<div class="mainMenu">Home and all of the news</div><p>{LONG}</p>', LONG),
        (f"<p>{LONG}</p><p hidden>{LONG}</p><p style='display: none'>{LONG}</p>", LONG), (f"<article><p>{LONG} <button>Copy</button></p></article>", LONG), (f'<article><p>{LONG}</p><div id="comments"><article class="comment"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article></div></article>', LONG),
        (f'<aside class="related"><article><a>Another story of the day</a></article></aside><article><p>{LONG}</p></article>', LONG), (f'<div class="cookie-consent"><p>{LONG}</p><p>{LONG}</p></div><article><p>{LONG}</p></article>', LONG),
    ],
)
def test_markup(page, want):
    got = html_text.main_text(page, TREE)
    assert got.replace("One\n\n", "") == want


#: Layouts that the tree wasn't trained on: text of the article in capitals, other text in small letters.
HELD_OUT = (
    "<div id=top><span>{3}</span><a>{2}</a><a>{1}</a></div><div id=wrap><div id=left><ul><li><a>{2}</a><li><a>{3}</a><li><a>{2}</a></ul></div><div id=text><h2>{T5}</h2><p>{T35}</p><blockquote>{T18}</blockquote><p>{T50}</p><p>{T8}</p></div></div><div id=foot><a>{1}</a> <a>{2}</a></div>",
    "<body><section role=banner><p>{4}</p></section><section><h1>{T7}</h1><p>{T22}</p><figure><figcaption>{T9}</figcaption></figure><p>{T48}</p><p>{T26}</p></section><section class=newsletter-signup><p>{20}</p></section><section role=contentinfo><p>{12}</p></section>",
    "<center><font><a>{1}</a> <a>{1}</a> <a>{2}</a></font></center><h1>{T4}</h1>{T40}<p>{T33}<p>{T29}<hr><a>{3}</a> <a>{2}</a>",
    "<main><header><h1>{T6}</h1><p>{T3}</p></header><section><p>{T30}</p><pre>{T12}</pre><dl><dt>{T2}<dd>{T10}<dt>{T1}<dd>{T14}</dl></section><div class=shareBar><a>{1}</a></div></main><div id=relatedPosts><p>{24}</p></div>",
    "<table><tr><td colspan=2><a>{1}</a> <a>{2}</a> <a>{1}</a><tr><td><a>{2}</a><br><a>{3}</a><br><a>{2}</a><td><p>{T31}<p>{T17}<p>{T44}</table>",
)


def test_layouts_held_out():
    """Of the words of each class, how many come out right."""
    right = [0, 0]
    total = [0, 0]
    for page in HELD_OUT:
        filled = re.sub(r"\{(T?)(\d+)\}", lambda m: " ".join(["WORD" if m[1] else "word"] * int(m[2])), page)
        got = html_text.main_text(filled, TREE)
        for k, word in enumerate(("WORD", "word")):
            n = filled.count(word)
            total[k] += n
            right[k] += got.count(word) if k == 0 else n - got.count(word)
    assert right[0] >= 0.98 * total[0] and right[1] >= 0.9 * total[1]


class _Articles(HTMLParser):
    """Blocks of the text inside <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_pages_against_a_plain_parser():
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    for page in pages.html:
        parser = _Articles()
        parser.feed(page)
        assert html_text.main_text(page, TREE) == "\n\n".join(" ".join(b.split()) for b in parser.blocks if b.split())


def test_long_pieces_like_tiktoken():
    import public_tokenizers
    import tiktoken

    path, pattern = bpe.default_files()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary = bpe.Vocabulary(path)
    rng = random.Random(9)
    alphabets = ["ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "äöüß", "日本語中文字"]
    for n in (193, 400, 3000):
        for letters in alphabets:
            t = "".join(rng.choice(letters) for _ in range(n))
            assert vocabulary.encode_pieces([t.encode()])[0] == plain.encode_ordinary(t), (n, letters)
    for t in ["a" * 2501, "abc" * 900, "the" * 800 + "re" * 300]:
        assert vocabulary.encode_pieces([t.encode()])[0] == plain.encode_ordinary(t)


def test_tokens_that_pair_early_merge_one_by_one(tmp_path):
    # "abc" comes before "ab", of which it can be made; without "bc" only from it
    ranks = [bytes([i]) for i in range(256)] + [b"cab", b"ab", b"ca"]
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(x) + b" " + str(i).encode() + b"\n" for i, x in enumerate(ranks)))
    v = bpe.Vocabulary(str(tmp_path / "r"))
    assert 257 in v.early

    def slow(piece):
        ids = list(piece)
        while True:
            pairs = [(v.ranks.get(b"".join(v.bytes_of[i] for i in ids[k : k + 2])), k) for k in range(len(ids) - 1)]
            pairs = [p for p in pairs if p[0] is not None]
            if not pairs:
                return ids
            r, k = min(pairs)
            ids[k : k + 2] = [r]

    rng = random.Random(1)
    for _ in range(200):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 60)))
        assert v._encode_long(piece) == slow(piece)


def test_many_boundaries_in_few_passes(spark, monkeypatch):
    passes = []
    count = sharding._histogram
    monkeypatch.setattr(sharding, "_histogram", lambda *a: passes.append(len(a[1])) or count(*a))
    rows = spark.range(20_000).selectExpr("xxhash64(id) key", "id", "1L one")
    cuts = sharding.find_splitters(rows, 500, 20_000, "one", tolerance=0.3, whole=0.3)
    keys = np.sort(rows.toPandas().key.to_numpy())
    sizes = np.diff([0, *np.searchsorted(keys, [c[0] for c in cuts]), 20_000])
    assert len(cuts) == 499 and sizes.min() >= 16 and sizes.max() <= 64
    assert len(passes) <= 6 and max(passes) <= sharding.ALL_PROBES + 3 * 499


def test_shard_sizes_of_documents(spark):
    s = sharding.op4_histogram_sharding(spark, "/root/testdata/sf0.1").toPandas()
    sizes = s.groupby("shard")["size"].sum()
    most = s.groupby("text_crc32")["size"].sum().max()  # copies of a text stay together if they can
    assert len(s) == 10_000 and sizes.max() - sizes.min() <= 0.03 * sizes.mean() + most + s["size"].max()


def test_site_quality_by_brute_force(spark):
    """Of each document the posteriors of its path and host without itself, worked out one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    seen = []
    strength = site_quality._strength
    with pytest.MonkeyPatch.context() as m:
        m.setattr(site_quality, "_strength", lambda *a: seen.append(strength(*a)) or seen[-1])
        got = site_quality.site_quality(docs, labels).toPandas().set_index("doc_id")
    t = docs.select("doc_id", "source", "lang").toPandas().set_index("doc_id")
    label = labels.toPandas().dropna().groupby("doc_id").quality.max()
    e = {i: float(label[i] > 0) if i in label.index else got.evidence[i] for i in t.index}
    total = sum(e.values()) / len(e)
    logit = lambda q: math.log(max(q, 1e-6) / max(1 - q, 1e-6))
    for i, row in t.iterrows():
        of_host = [e[j] for j in t.index[t.source == row.source] if j != i]
        host = (sum(of_host) + seen[0] * total) / (len(of_host) + seen[0])
        of_path = [e[j] for j in t.index[(t.source == row.source) & (t.lang == row.lang)] if j != i]
        path = (sum(of_path) + seen[1] * host) / (len(of_path) + seen[1])
        want = 1 / (1 + math.exp(-(logit(got.evidence[i]) + logit(path) - logit(total))))
        assert abs(got.host_posterior[i] - host) < 1e-9 and abs(got.path_posterior[i] - path) < 1e-9 and abs(got.score[i] - want) < 1e-9


def test_every_label_is_pooled(spark):
    """The curve is fitted on a few labels; the posteriors know all of them."""
    rows = [(i, f"plain words number {i % 7} here", "good" if i % 2 else "bad", "en") for i in range(2000)]
    docs = spark.createDataFrame(rows + [(None, "plain words", "good", "en")] * 3, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    few, all_ = (site_quality.site_quality(docs, labels, max_labelled=n).toPandas().set_index("doc_id") for n in (200, 20_000))
    known = few[few.index.notna()]
    assert len(few) == 2003 and known.host_posterior[known.index % 2 == 1].min() > 0.99 and known.host_posterior[known.index % 2 == 0].max() < 0.01
    assert np.abs(known.host_posterior - all_[all_.index.notna()].host_posterior).max() < 0.01


def test_site_quality_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "u", 1, 2, 3), (1, "c d", None, "u", 1, 2, 3), (None, None, None, None, 1, 2, 3)], "doc_id long, text string, n string, s string, evidence int, __y int, mean int")
    labels = spark.createDataFrame([(1, 1, 7), (1, 0, 7)], "doc_id long, quality int, text int")
    got = site_quality.site_quality(docs, labels, host_cols=("n",), path_cols=("n", "s")).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)


def test_paraphrases_are_found(spark):
    """Items with a fifth of the words before the answer replaced, between texts of the corpus: recall of the whole search."""
    rng = random.Random(11)
    bench = pd.read_parquet("/root/testdata/sf0.1/benchmark.parquet")
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    pool = [w for t in docs.text[:200] for w in t.split()]
    rows, want = [(int(i), t) for i, t in zip(docs.doc_id, docs.text, strict=True)], set()
    for n, (item, text) in enumerate(zip(bench.item_id, bench.text, strict=True)):
        w = text.split()
        body = len(w) - max(len(w) // 4, min(len(w), 3))
        for k in rng.sample(range(body), body // 5):
            w[k] = rng.choice(pool)
        around = [" ".join(rng.choice(pool) for _ in range(rng.randrange(20, 60))) for _ in range(2)]
        rows.append((10**6 + n, f"{around[0]} {' '.join(w)} {around[1]}"))
        want.add((10**6 + n, int(item)))
    leaks = decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench))
    got = {(r.doc_id, r.item_id) for r in leaks.collect()}
    assert len(want & got) >= 0.9 * len(want)
    print("recall of paraphrases", len(want & got) / len(want))


def test_a_hot_group_is_dealt_over_parts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(suffix_dedup, "PARTS", 8)
    rows = spark.range(900).selectExpr("if(id % 3 = 0, -1, id) as key", "id as doc")
    rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("doc").alias("first")).write.parquet(str(tmp_path / "groups"))
    groups = spark.read.parquet(str(tmp_path / "groups"))
    got = suffix_dedup._of_groups(rows, groups, ["key"])
    assert sorted(got.collect()) == sorted(rows.join(groups, "key").drop("rows").collect())


def test_texts_put_end_to_end_give_the_same_blocks_and_windows():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 101, n).astype(np.uint8) for n in (400, 100, 151, 1000, 260)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ids = np.array([7, 3, 90, 4, 11])
    owner, start, n, lead = (np.concatenate(x) for x in zip(*[(np.full(len(r[0]), i), r[1], r[2], r[3]) for i, t in enumerate(texts) for r in [suffix_dedup.anchor_rows(t, np.array([0, len(t)]))]], strict=True))
    for of_rows in (suffix_dedup._blocks, suffix_dedup._single):
        got = of_rows(np.concatenate(texts), offsets, ids, owner, start + offsets[owner], n, lead).to_pylist()
        alone = [of_rows(t, np.array([0, len(t)]), ids[i : i + 1], np.zeros(sum(owner == i), int), *(x[owner == i] for x in (start, n, lead))).to_pylist() for i, t in enumerate(texts)]
        assert got == [r for rows in alone for r in rows] and {r["doc"] for r in got} == set(ids.tolist())


def test_passes_over_all_documents_take_small_batches(spark, monkeypatch):
    seen = {}
    for name in ("document_frequencies", "latent_basis"):
        own = getattr(decontamination, name)
        monkeypatch.setattr(decontamination, name, lambda *a, own=own, name=name: (seen.update({name: spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")}), own(*a))[1])
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 9) for i in range(40)], "doc_id long, text string")
    decontamination.find_leaks(docs, spark.createDataFrame([(1, "some words of text 1 some words")], "item_id long, text string"))
    assert seen == {"document_frequencies": "2000", "latent_basis": "2000"} and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
