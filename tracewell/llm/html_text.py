"""HTML extraction: boosted trees over DOM nodes with hierarchical decoding.

A page becomes a tree of block elements whose leaves are text runs. Gradient-boosted trees score
every node: its tag and attribute tokens, those of its ancestors, its depth, the length, link share
and punctuation of its subtree, its share of the page and how it compares with its siblings. A node
is content if its subtree holds main text, so a content node needs a content parent. Decoding picks
the labelling with the highest total score among those that respect this: bottom-up, a subtree is
worth its node's score and its children's worth, or nothing if that is negative.

The model is fitted on the driver from at most ``TRAIN_PAGES`` pages, chosen by hash. Their own main
and surrounding texts are laid out again in many page structures, so the label of each block is
known; this is the only place that samples. Every page is extracted whole.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
an empty line. Null or empty html, and pages without main text, give the empty text. Rows are
independent, so ties and repeats do no harm; an empty table gives an empty result; columns that have
the names of the results are replaced.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import table

TRAIN_PAGES, TRAIN_CHARS, LAYOUTS = 200, 60_000, 2
TREES, DEPTH, BINS, RATE, L2 = 40, 4, 32, 0.3, 1.0
BATCH_NODES = 20_000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^<>]*>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LETTERS = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?]")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"}
HIDDEN = {"head", "select", "button", "object", "label", "option"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
BLOCK = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr center".split()
)
CLOSES_P = BLOCK - {"html", "body"}
#: Elements that end an open one of the same kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
GROUPS = {
    "main": "article main content post entry story body text",
    "menu": "nav navigation menu breadcrumb breadcrumbs pagination toc",
    "head": "header masthead logo brand banner",
    "foot": "footer copyright legal imprint",
    "side": "aside sidebar widget rail",
    "ad": "ad ads advert advertisement sponsor sponsored promo",
    "talk": "comment comments reply replies discussion respond",
    "notice": "cookie cookies notice consent alert popup modal newsletter subscribe",
    "share": "share social related recommended tags byline",
    "form": "form search login signup",
}
_GROUP_OF = {word: i for i, words in enumerate(GROUPS.values()) for word in words.split()}
TAGS = ["p", "h", "li", "div", "section", "article", "main", "ul", "td", "table", "blockquote", "pre", "form", "body"]
_TAG_OF = {t: i for i, t in enumerate(TAGS)} | {f"h{i}": 1 for i in range(1, 7)} | {"ol": 7, "th": 8}


class Page:
    """Nodes in page order: parents precede children; leaves that hold text are runs."""

    __slots__ = ("parent", "tag", "own", "chars", "links", "marks", "text", "label")

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.own = [-1], ["body"], [0]
        self.chars, self.links, self.marks = [0], [0], [0]
        self.text: list[str | None] = [None]
        self.label: list[bool] = [False]
        self._parse(source)

    def _add(self, parent: int, tag: str, own: int, text: str | None = None, links: int = 0, label: bool = False) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.own.append(own)
        self.text.append(text)
        self.chars.append(len(text) if text else 0)
        self.links.append(min(links, self.chars[-1]))
        self.marks.append(len(_MARKS.findall(text)) if text else 0)
        self.label.append(label)
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        # the stack holds (tag, node); inline elements have the node of their block
        stack: list[tuple[str, int]] = []
        parts: list[str] = []
        links = hidden = anchors = marked = seen = at = 0

        def flush() -> None:
            nonlocal links, seen
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    self._add(stack[-1][1] if stack else 0, "#", 0, text, links, seen > 0)
                parts.clear()
            links = seen = 0

        def pop() -> None:
            nonlocal hidden, anchors, marked
            tag, node = stack.pop()
            hidden -= tag in HIDDEN
            anchors -= tag == "a"
            marked -= tag == "x-main"

        n = len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            end = m.start() if m else n
            if end > at and not hidden:
                piece = source[at:end]
                parts.append(piece)
                seen += marked
                if anchors:
                    links += len(piece)
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if any(t == tag for t, _ in stack):
                    if tag in BLOCK:
                        flush()
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
                at = close.end() if close else n
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    parts.append(" ")
                continue
            if tag == "body":  # ends a head that was left open
                flush()
                while stack:
                    pop()
            node = stack[-1][1] if stack else 0
            if tag in BLOCK:
                flush()
                ends = {"p"} if tag in CLOSES_P and any(t == "p" for t, _ in stack) else set()
                ends |= SIBLINGS.get(tag, set())
                while ends and (k := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ends), -1)) >= 0:
                    if any(t in ("ul", "ol", "dl", "table") for t, _ in stack[k + 1 :]):
                        break
                    while len(stack) > k:
                        pop()
                node = stack[-1][1] if stack else 0
                own = 1 << _GROUP_OF[tag] if tag in _GROUP_OF else 0
                for values in _ATTRIBUTE.findall(m[3] or m[6] or ""):
                    for word in _LETTERS.findall("".join(values).lower()):
                        if word in _GROUP_OF:
                            own |= 1 << _GROUP_OF[word]
                node = self._add(node, tag, own)
            stack.append((tag, node))
            hidden += tag in HIDDEN
            anchors += tag == "a"
            marked += tag == "x-main"
        flush()

    def features(self) -> np.ndarray:
        n = len(self.parent)
        parent = np.array(self.parent)
        chars, links, marks = (np.array(x, float) for x in (self.chars, self.links, self.marks))
        runs = np.array([t is not None for t in self.text], float)
        depth, inherited = np.zeros(n), list(self.own)
        for i in range(1, n):
            depth[i] = depth[self.parent[i]] + 1
            inherited[i] |= inherited[self.parent[i]]
        start = np.cumsum(chars) - chars
        count = runs.copy()
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            marks[p] += marks[i]
            count[p] += count[i]
        children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
        brood = np.bincount(parent[1:], chars[1:], minlength=n) if n > 1 else np.zeros(n)
        up = np.maximum(parent, 0)
        siblings = np.maximum(1, children[up])
        mean = brood[up] / siblings
        bits = np.arange(len(GROUPS))
        own = (np.array(self.own)[:, None] >> bits) & 1
        above = (np.array(inherited)[:, None] >> bits) & 1
        tags = np.zeros((n, len(TAGS)))
        kinds = np.array([_TAG_OF.get(t, -1) for t in self.tag])
        tags[kinds >= 0, kinds[kinds >= 0]] = 1
        # a run also shows the tag that holds it
        tags = np.where(runs[:, None] > 0, tags[up], tags)
        total = max(1.0, chars[0])
        plain = np.stack(
            [
                np.minimum(depth, 20), runs, np.log1p(chars), links / np.maximum(1, chars), 20 * marks / np.maximum(20, chars),
                np.log1p(count), np.log1p(chars / np.maximum(1, count)), chars / total, start / total,
                np.minimum(siblings, 50), np.log1p(mean), chars / np.maximum(1, mean), np.minimum(children, 50),
            ],
            axis=1,
        )
        return np.concatenate([plain, tags, own, above], axis=1)

    def content(self) -> np.ndarray:
        """For training: whether each subtree holds a marked run."""
        out = np.array(self.label)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] |= out[i]
        return out

    def main_text(self, score: np.ndarray) -> str:
        worth = score.copy()
        for i in range(len(worth) - 1, 0, -1):
            worth[self.parent[i]] += max(0.0, worth[i])
        chosen = worth > 0
        for i in range(1, len(worth)):
            chosen[i] &= chosen[self.parent[i]]
        return "\n\n".join(t for t, c in zip(self.text, chosen, strict=True) if t is not None and c)


@dataclass
class Forest:
    """Complete trees of one depth: a feature and a cut per inner node, a value per leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Newton boosting of the logistic loss on binned features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c) for q, c in zip(cuts, x.T, strict=True)], axis=1)
    n, width = binned.shape
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    score = np.full(n, start)
    inner = 2**DEPTH - 1
    features, values, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, int)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, k = 2**level - 1, 2**level
            local = node - first
            best = np.full(k, 1e-6)
            for f in range(width):
                cell = local * BINS + binned[:, f]
                gs = np.bincount(cell, g, k * BINS).reshape(k, BINS).cumsum(1)
                hs = np.bincount(cell, h, k * BINS).reshape(k, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain = gain[:, : len(cuts[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                top = gain[np.arange(k), at]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[first + better] = f
                cut[first + better] = cuts[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        size = 2**DEPTH
        value = RATE * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + L2)
        score += value[leaf]
        features.append(feature)
        values.append(cut)
        leaves.append(value)
    return Forest(np.array(features), np.array(values), np.array(leaves), start)


def _sentences(text: str, k: int) -> str:
    return html.escape(text[: 20 + k % 180])


class Layouts:
    """Page structures around given texts; elements named x-main hold the main text."""

    def __init__(self, mains: list[list[str]], others: list[str], seed: int) -> None:
        self.mains, self.others, self.random = mains, others or ["home"], random.Random(seed)

    def _other(self) -> str:
        return html.escape(self.random.choice(self.others))

    def _some(self) -> str:
        blocks = self.random.choice(self.mains)
        return _sentences(self.random.choice(blocks), self.random.randrange(1000))

    def _links(self) -> str:
        items = "".join(f'<li><a href="/x">{self._other()[:20]}</a></li>' for _ in range(self.random.randrange(3, 12)))
        return f"<ul>{items}</ul>"

    def _wrap(self, tags: list[str], inner: str) -> str:
        tag = self.random.choice(tags)
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def _around(self) -> dict[str, str]:
        w = self._wrap
        talk = "".join(f"<p>{self._some()}</p>" for _ in range(self.random.randrange(1, 6)))
        return {
            "menu": w(["nav", 'div class="menu"', 'div id="main-nav"', 'ul class="breadcrumb"'], self._links()),
            "head": w(["header", 'div class="masthead"', 'div id="header"'], f"<h2>{self._other()}</h2><p>{self._other()}</p>"),
            "foot": w(["footer", 'div class="footer"', 'div id="legal"'], f"<p>&copy; {self._other()}</p>{self._links()}"),
            "side": w(["aside", 'div class="sidebar"', 'div class="widget"'], f"<h3>{self._other()}</h3>{self._links()}<p>{self._some()}</p>"),
            "ad": w(['div class="ad"', 'div class="sponsored"', 'section class="promo"'], self.random.choice([self._other(), f"<p>{self._some()}</p>"])),
            "talk": w(['div id="comments"', 'section class="comments"', 'ol class="replies"', 'div class="discussion"'], talk),
            "notice": w(['div class="cookie-notice"', 'div class="newsletter"', 'div role="alert"'], f"<p>{self._some()}</p><a href='/ok'>ok</a>"),
            "share": w(['div class="share"', 'div class="related"', 'ul class="tags"'], self._links()),
            "form": w(["form", 'div class="search"'], f"{self._other()} <input name=q>"),
        }

    def page(self) -> str:
        r = self.random
        blocks = r.choice(self.mains)
        around = self._around()
        body = []
        for i, b in enumerate(blocks):
            tag = "h1" if not i and r.random() < 0.7 else r.choice(["p"] * 8 + ["li", "blockquote", "h2", "pre", "div"])
            body.append(f"<{tag}><x-main>{html.escape(b)}</x-main></{tag}>")
            if r.random() < 0.04:
                body.append(around[r.choice(["ad", "share", "notice"])])
        if r.random() < 0.2:
            body.append(around["talk"])
        tags = ["article", "main", 'div class="content"', 'div class="post-body"', 'div id="story"', "div", "section", 'div class="entry"']
        main = self._wrap(tags, "".join(body))
        if r.random() < 0.3:
            main = self._wrap(["div", "main", 'div id="wrapper"', "form"], main)
        before = [around[k] for k in ("notice", "head", "menu", "ad", "form") if r.random() < 0.5]
        after = [around[k] for k in ("share", "talk", "side", "ad", "foot") if r.random() < 0.5]
        return f"<html><body>{''.join(before)}{main}{''.join(after)}</body></html>"


def train(pages: list[str], seed: int = 1) -> Forest:
    """The model from ``pages`` that mark their main text by an article or main element, and from
    layouts of the texts inside and outside of it."""
    mains, others, xs, ys = [], [], [], []
    for source in pages:
        page = Page(source)
        inside = []
        for i, text in enumerate(page.text):
            if text is None:
                continue
            k = i
            while k >= 0 and page.tag[k] not in ("article", "main"):
                k = page.parent[k]
            page.label[i] = k >= 0
            (inside if k >= 0 else others).append(text)
        if inside:
            mains.append(inside)
            xs.append(page.features())
            ys.append(page.content())
    if not mains:
        mains = [[t for t in others if len(t) > 80] or ["A line of text that stands for an article, with a comma."]]
    layouts = Layouts(mains, others, seed)
    for _ in range(LAYOUTS * max(50, len(mains))):
        page = Page(layouts.page())
        xs.append(page.features())
        ys.append(page.content())
    return fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def fit_on(pages: DataFrame, source: str = "html") -> Forest:
    """Fit on at most ``TRAIN_PAGES`` different pages of moderate length, the ones with the least hashes.

    The hashes are ranked without the pages; only the chosen pages come to the driver.
    """
    short = pages.where(F.length(source).between(1, TRAIN_CHARS)).select(F.xxhash64(source).alias("h"), source)
    last = short.select("h").distinct().orderBy("h").limit(TRAIN_PAGES).agg(F.max("h")).first()[0]
    chosen = short.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min(source).alias(source))
    return train([r[1] for r in sorted(chosen.collect())])


def extractor(forest: Forest):
    """Pandas UDF: html to main text."""

    @F.pandas_udf("string")
    def extract_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def decided(waiting: list[Page]) -> list[str]:
            if not waiting:
                return []
            features = [p.features() for p in waiting]
            score = forest.score(np.concatenate(features))
            ends = np.cumsum([len(f) for f in features])[:-1]
            return [p.main_text(s) for p, s in zip(waiting, np.split(score, ends), strict=True)]

        for batch in batches:
            out: list[str] = []
            waiting, nodes = [], 0
            for source in batch:
                waiting.append(Page(source or ""))
                nodes += len(waiting[-1].parent)
                if nodes >= BATCH_NODES:
                    out += decided(waiting)
                    waiting, nodes = [], 0
            yield pd.Series(out + decided(waiting), dtype=object)

    return extract_text


def extract(pages: DataFrame, forest: Forest | None = None, source: str = "html", text: str = "text") -> DataFrame:
    forest = forest or fit_on(pages, source)
    return pages.withColumn(text, extractor(forest)(F.col(source)))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
SQL: dict[str, str] = {}
