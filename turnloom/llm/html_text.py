"""Main text of web pages by flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its word count and link density, those of its
two neighbours, whether it is a heading, whether an article encloses it, and what the elements around it are called; a decision tree says whether it
belongs to the article. It is trained here on TRAINING, small pages of several layouts whose blocks are labelled.

Elements close as HTML lets them: a list item, table cell or paragraph ends where the next begins or its list, row or
parent ends. Attributes are read with their quotes. Whole words in class, id and role are evidence (`ad`, `site-footer`, `mainMenu`);
words that only say what an element has or lacks are not (`with-sidebar`, `no-banner`), nor are those of articles, and some (`legal`, `search`) not within one.
An element that holds most of a page's running text, with the article in it, is no menu, form or sidebar, whatever it is called; comments,
asides, footers and what is hidden are, even so.

Defined results: a null or empty page has the empty text; broken markup is read as far as it
goes (an open comment, script, style or tag runs to the end; an open svg, select or other embedded element is only a tag); every page is read for itself, repeated ones
too; an empty table gives an empty result; other columns aren't read.
"""

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ._store import table
from ._text import released

#: Elements whose content is no markup, and runs to the end if they aren't closed; and such as embed something, if they are closed.
RAW, EMBEDDED = "script|style|textarea|title|iframe|noembed", "noscript|template|svg|math|select|object|canvas|audio|video|button"
#: The rest of a tag: a quoted value may hold any character, also the one that ends the tag.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_MARKUP = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:svg|math)\b{_REST}(?<=/)>|<({RAW})\b{_REST}>.*?(?:</\1\s*>|\Z)|<({EMBEDDED})\b{_REST}>.*?</\2\s*>|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[a-zA-Z/!?]{_REST}(?:>|\Z)", re.S | re.I
)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)")
_ATTRIBUTE = re.compile(r"""[\s/]([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
#: Elements and words of class, id and role that enclose what isn't the article.
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu submenu topbar sidenav footer sidebar aside ad ads advert advertisement adverts banner cookie cookies consent notice notices popup modal promo promotion sponsor "
    "sponsored share sharing social related comment comments commentlist respond disqus reply replies breadcrumb breadcrumbs newsletter subscribe subscription login signup pagination pager toolbar "
    "masthead contentinfo complementary".split()
)
#: Words that are so outside articles only; header, unless it is that of an article or a section.
OUTER_WORDS = frozenset("alert legal copyright search widget header".split())
OWN_HEADERS = frozenset("article entry post section content story page-title title".split())
#: What stays so even if most of the page's text is in it.
LASTING = frozenset("comment comments commentlist respond disqus reply replies cookie cookies consent".split())
LASTING_TAGS = frozenset("aside footer dialog".split())
#: First words of names that tell what an element has, not what it is.
MODIFIERS = frozenset("has have no not with without is hide show above below before after type category tag".split())
VOID = frozenset("area base col embed hr img input link meta param source track".split())
#: What an opening tag closes, up to an element of the second set.
_CELLS = frozenset("td th".split())
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (_CELLS, frozenset("tr table".split())), "th": (_CELLS, frozenset("tr table".split())), "tr": (frozenset(["tr"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset()),
}
PARAGRAPH = (frozenset(["p"]), frozenset("li td th dd article section main div body blockquote aside nav footer header form figure table ul ol dl".split()))


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "named", "article", "heading")
#: Pages of several layouts. +9 stands for a block of nine words of the article, -9 for one that isn't; "a9" after it: nine words more, in links.
#: named: what encloses a block is called by BOILER_*; article: an <article> or <main> encloses it, 1; the page has one elsewhere, -1; the page has none, 0.5.
TRAINING = (
    # an article between menu, sidebar and footer
    "<header>-3</header><nav><ul><li>-0a1<li>-0a1<li>-0a2</ul></nav><div class=ad>-9</div><article><h1>+6</h1><p>+60<p>+1<p>+45<p>+3a5<p>+80<p>+5</article><aside><p>-12<p>-25</aside><div class=comments><p>-30<p>-9</div><footer>-7</footer>",
    "<nav>-0a2 -0a3</nav><main><h1>+4</h1><p>+0a3<p>+25<h2>+2</h2><ul><li>+0a4<li>+0a6<li>+0a3</ul><p>+12</main><div class=widget>-20</div><p>-40<p>-4",
    "<article><p>+21<p>+0a4<p>+21</article>", "<article><p>+21<p>+5</article><ul><li>-0a1<li>-0a2</ul>", "<article><p>+1<p>+2<p>+1<div class=promo>-35</div><p>+30<div class=sharing>-0a1 -0a1</div></article><p>-9",
    "<aside><article>-0a5</article><article>-0a6</article></aside><article><p>+40<p>+9</article>", "<article><h1>+5</h1><p>+30<div class=related><p>-0a8<p>-1a5</div><p>+22<div class=ad>-11</div><p>+16</article>",
    # a blog of divisions without such elements
    "<div class=menu><a>-0a1</a></div><div id=content><h1>+5</h1><p>+40<p>+18a2<p>+70<h2>+3</h2><p>+33<p>+9</div><div class=sidebar><h3>-2</h3><ul><li>-0a4<li>-0a5</ul></div><div class=comment><p>-50</div>",
    "<ul><li>-0a1<li>-0a2<li>-0a1</ul><h1>+4</h1><p>+60<p>+45<p>+15<p>+25<ul><li>-0a3<li>-0a2</ul><p>-3",
    "<p>-0a2<p>-0a3<h1>+2</h1><p>+35<p>+4<p>+22<p>+8<p>+11<ul><li>-0a5<li>-0a4<li>-1a6</ul>",
    # tables for layout
    "<table><tr><td>-0a1<td>-0a2<td>-0a1<tr><td class=sidebar>-9<td><h1>+5</h1><p>+55<p>+19<p>+24<p>+6<tr><td>-1a2</table>",
    # a bare page, a list of links, a page of short lines
    "<p>+60<p>+45<p>+9", "<p>+21", "<p>+5", "<h1>+3</h1><p>+12<p>+7<p>+10<p>+14", "<p>-0a3<p>-0a4<p>-2a6<p>-0a2<p>-0a5", "<h3>-2</h3><p>-0a4<p>-0a3<p>+50<p>+30<h3>-2</h3><p>-0a4<p>-0a6",
    # news with promotions and references
    "<p>-0a1<p>-0a1<h1>+8</h1><p>+4<p>+38<p>-3a9<p>+41<p>-0a8<p>+27<h2>+1</h2><p>+22<p>+16a2<h3>-3</h3><p>-0a6<p>-0a7<p>-2a1",
    "<h1>+5</h1><p>+30<div class=newsletter><p>-25</div><p>+28<form><p>-12</form><p>+31<div class=related><h3>-2</h3><p>-0a7</div>",
    # a forum and a shop
    "<div class=breadcrumbs>-0a1 -0a2</div><h1>+6</h1><p>+80<p>+20<div class=replies><p>-70<p>-45<p>-15</div><div class=pagination>-0a1 -0a1</div>", "<p>-0a2<h1>+4</h1><p>+90<ul><li>+6<li>+8<li>+5</ul><p>+20<p>-0a3<p>-1a2",
)


def labelled(pages=TRAINING) -> list[tuple]:
    """Values of FEATURES and the label of each block of TRAINING."""
    rows = []
    for page in pages:
        marked = re.sub(r"([+-])(\d+)(?:a(\d+))?", lambda m: " ".join(["yes" if m[1] == "+" else "no"] * int(m[2])) + (f" <a>{' '.join(['yes' if m[1] == '+' else 'no'] * int(m[3]))}</a>" if m[3] else ""), page)
        found = blocks(marked)
        rows += [(*x, int(b[0].startswith("yes"))) for b, x in zip(found, features(found), strict=True)]
    return rows


LEAST_ROWS = 2


def train(rows=None, depth: int = 8):
    """A CART tree by Gini impurity: (feature, threshold, tree up to it, tree above it), or the label."""
    rows = labelled() if rows is None else rows
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part):
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None  # each side has LEAST_ROWS rows at least
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            if min(len(low), len(high)) < LEAST_ROWS:
                continue
            cost = impurity(low) + impurity(high)
            if best is None or cost < best[0]:
                best = (cost, f, cut, low, high)
    if best is None:
        return int(2 * ones >= len(rows))
    return best[1], best[2], train(best[3], depth - 1), train(best[4], depth - 1)


def predict(tree, features) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


NAMED, LASTS = 1, 2


def _attributes(tag: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(tag):
        out.setdefault(name.lower(), "".join(value))
    return out


def _evidence(name: str, tag: str, within: bool) -> int:
    """What an element's tag says: 0, NAMED (not the article, by all that it is called) or LASTS (whatever is in it); within: an article encloses it."""
    own = _attributes(tag)
    if "hidden" in own or re.search(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", own.get("style", ""), re.I):
        return LASTS
    out = LASTS if name in LASTING_TAGS else NAMED if name in BOILER_TAGS or name == "header" and not within else 0
    if name in ("body", "html"):
        return 0
    for called in " ".join(own.get(k, "") for k in ("class", "id", "role")).split():
        parts = re.findall("[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", called).lower())
        if not parts or parts[0] in MODIFIERS:
            continue
        if not LASTING.isdisjoint(parts):
            out = LASTS
        elif name not in ("article", "main") and (not BOILER_WORDS.isdisjoint(parts) or not within and not OUTER_WORDS.isdisjoint(parts) and not ("header" in parts and not OWN_HEADERS.isdisjoint(parts))):
            out = max(out, NAMED)
    return out


#: Words of a block of running text at least, its links at most, and the part of such text in an element that isn't what it is called; the same where no article is in it.
RUNNING, RUNNING_LINKS, MOST, NEARLY_ALL = 15, 0.3, 0.5, 0.8


def blocks(page: str) -> list[tuple[str, int, int, bool, float, bool]]:
    """Flat blocks in page order: text, words, words in links, named, article (see TRAINING), heading."""
    out, parts, links = [], [], []
    stack: list[tuple[str, int, int]] = []  # enclosing elements: name, evidence, number
    named: list[tuple[int, int]] = []  # of those with evidence: number (0 within an article), evidence
    numbers = article = in_link = 0
    heading = False
    has_article = re.search(r"<(?:article|main)\b", page, re.I) is not None

    def close() -> None:
        nonlocal parts, links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, len(text.split()), len(html.unescape(" ".join(links)).split()), tuple(named), article > 0, heading))
        parts, links = [], []

    def leave(depth: int) -> None:
        nonlocal article
        while len(stack) > depth:
            name, was, _ = stack.pop()
            if was:
                named.pop()
            article -= name in ("article", "main")

    def end(names: frozenset, within: frozenset) -> None:
        """Leaves the innermost of names, if no element of within is inside it."""
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                return leave(depth)
            if stack[depth][0] in within:
                return None

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                links.append(page[at : m.start()])
        at = m.end()
        tag = _TAG.match(m[0])
        if m[1] or m[2] or not tag or m[0].endswith("/>") and tag[2].lower() in ("svg", "math"):
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "button":  # one without an end
            continue
        bad = 0 if closing else _evidence(name, m[0], article > 0)
        if name in INLINE and not bad and not (closing and any(n == name for n, _, _ in stack)):
            continue  # an inline element is on the stack only if its names say that it isn't the article
        close()
        in_link = in_link if name in INLINE else 0
        if closing:
            end(frozenset([name]), frozenset())
            heading = False
            continue
        if name in CLOSES:
            end(*CLOSES[name])
        elif name not in INLINE:
            end(*PARAGRAPH)
        heading = re.fullmatch("h[1-6]", name) is not None
        if name not in VOID and name not in ("body", "html", "head", "wbr"):
            numbers += 1
            stack.append((name, bad, numbers))
            if bad:
                named.append((0 if article else numbers, bad))
            article += name in ("article", "main")
    if at < len(page):
        parts.append(page[at:])
        if in_link:
            links.append(page[at:])
    close()
    running: dict[int, list[int]] = {}  # running words in each named element, and those of them in an article
    whole = 0
    for _, words, linked, own, inside, _ in out:
        if words >= RUNNING and linked <= RUNNING_LINKS * words:
            whole += words
            for number in {n for n, _ in own if n}:
                sums = running.setdefault(number, [0, 0])
                sums[0] += words
                sums[1] += words * inside
    wrong = {n for n, (words, inside) in running.items() if words > (MOST if inside > MOST * words else NEARLY_ALL if not has_article else 1) * whole}
    return [(text, words, linked, any(e == LASTS or n not in wrong for n, e in own), 1 if inside else -1 if has_article else 0.5, head) for text, words, linked, own, inside, head in out]


def features(found) -> list[tuple]:
    """Values of FEATURES for each of a page's blocks."""
    density = [b[2] / b[1] for b in found]
    beside = lambda i: (found[i][1], density[i]) if 0 <= i < len(found) else (0, 0.0)
    return [(b[1], density[i], *beside(i - 1), *beside(i + 1), int(b[3]), b[4], int(b[5])) for i, b in enumerate(found)]


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, x in zip(found, features(found), strict=True) if predict(tree, x))


def extract(pages: DataFrame, *, keep: list[str], html_col: str = "html") -> DataFrame:
    """Columns `keep`, text and n_chars of every page."""
    tree = train()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(x, tree) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pages.select(*keep).dtypes) + ", text string, n_chars long"
    return pages.select(*keep, html_col).mapInArrow(released(run), schema)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
