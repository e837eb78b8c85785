"""HTML extraction: main text of pages by gradient-boosted trees over DOM-node features.

A page becomes a list of nodes in page order: block elements, and the runs of text that they hold
directly. Boosted trees give each node the odds that it holds main text, from subtree density, link
share, attribute tokens, depth, ancestors and siblings. Decoding is hierarchical: of all choices in
which a node is kept only if its parent is, the likeliest is taken (a sum over each subtree), so a
dropped block never has kept text inside it. The trees are trained on made-up pages
(:mod:`html_pages`) with a fixed seed; their arrays lie in MODEL_FILE, which a test makes anew.

Pages are scanned once from start to end, whatever they hold. Where markup is broken, html's own rules decide (what
closes what, comments, quoted attributes, script and style to their end tag). Controls, drawings and embedded objects
are passed over up to their end tag or that of a block around them; a control ends at the next block too,
and a drawing or object that is never closed hides only itself.
"""

from __future__ import annotations

import functools
import html
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosted_trees, html_pages

#: Made-up pages to train on, their seed, and characters of html that are decoded at once.
TRAINING_PAGES, SEED, CHUNK_CHARS = 700, 7, 4_000_000
MODEL_FILE = Path(__file__).with_name("page_model.npz")
#: Elements nested deeper than this become siblings, as in browsers.
MAX_DEPTH = 512

# Fixed values of HTML: elements without content, elements whose content is no markup (to the page's end if never closed;
# only if closed), elements whose content is no text of the page, elements inside a line.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
RAW_IF_CLOSED = frozenset("title textarea iframe noframes noembed xmp".split())
CONTROLS = frozenset("button select".split())
HIDDEN = CONTROLS | frozenset("template svg math noscript object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
# what can't stand inside a button or a list of choices, and so ends one that is still open
ENDS_CONTROL = frozenset("p h1 h2 h3 h4 h5 h6 article section main nav header footer aside form table ul ol dl blockquote pre button select".split())
# what a start tag closes if it is open, up to these owners
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
# up to the end of a tag; a quote opens a value only after an equals sign, and only if it is closed
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_COMMENT_END = re.compile(r"--!?>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")

_TAGS = [{"article"}, {"main"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"section"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"pre", "blockquote", "figure", "figcaption"}]
_TAG = {t: k + 1 for k, group in enumerate(_TAGS) for t in group}
_KINDS = [*html_pages.NOISE_NAMES]
_TOKENS = {w: len(_KINDS) + 1 for name in html_pages.MAIN_NAMES for w in name.split("-")}
_TOKENS |= {w: k + 1 for k, kind in reversed(list(enumerate(_KINDS))) for name in html_pages.NOISE_NAMES[kind] for w in name.split("-") if w not in ("list", "form", "top", "body", "box", "bottom", "side", "site") or name == w}
_GOOD_TAGS, _BAD_TAGS = {"article", "main"}, {"nav", "header", "footer", "aside", "form"}
_NUMBERS = 16  # of the numeric features, before the one-hot ones


def _name_kinds(attributes: str) -> int:
    """Bit set of the kinds of block that the names in an element's attributes speak of."""
    return _short_name_kinds(attributes) if len(attributes) <= 200 else _find_kinds(attributes)


def _find_kinds(attributes: str) -> int:
    bits = 0
    for groups in _NAMES.findall(attributes):
        for word in _NAME_WORD.findall("".join(groups)):
            bits |= 1 << _TOKENS.get(word.lower(), 0)
    return bits & ~1


_short_name_kinds = functools.lru_cache(10_000)(_find_kinds)


class Nodes:
    """Nodes of many pages, in page order: a node's subtree is the run of nodes up to its end."""

    def __init__(self):
        self.tag, self.kinds, self.parent, self.end, self.depth, self.near = [], [], [], [], [], []
        self.chars, self.links, self.page, self.texts = [], [], [], []
        self.pages = 0

    def _add(self, tag: int, kinds: int, parent: int, depth: int, near: int) -> int:
        k = len(self.tag)
        self.tag.append(tag)
        self.kinds.append(kinds)
        self.parent.append(parent)
        self.end.append(k + 1)
        self.depth.append(depth)
        self.near.append(near)
        self.chars.append(0)
        self.links.append(0)
        self.page.append(self.pages)
        self.texts.append(None)
        return k

    def add_page(self, source: str) -> None:
        root = self._add(0, 0, -1, 0, 0)
        stack = [("", root, 0)]  # name, node, sign of the nearest block that has one
        opened: dict[str, int] = {}  # how many elements of a name are open
        last_end: dict[str, int] = {}  # where the page's last end tag of a name begins
        hidden, inner = "", {}  # the element that is passed over, and how many elements of a name are open in it
        run: list[str] = []
        linked = link = 0

        def flush():
            nonlocal run, linked
            if run:
                text = _SPACE.sub(" ", html.unescape("".join(run))).strip(" ")
                if text:
                    _, parent, near = stack[-1]
                    k = self._add(-1, 0, parent, len(stack), near)
                    self.chars[k], self.links[k], self.texts[k] = len(text), min(linked, len(text)), text
            run, linked = [], 0

        def close(to: int):
            flush()
            while len(stack) > to:
                name, node, _ = stack.pop()
                self.end[node] = len(self.tag)
                opened[name] = opened.get(name, 0) - 1

        def close_nearest(names, owners=()) -> bool:
            """Close the nearest open element with one of the names, unless an owner comes first."""
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in owners:
                    return False
                if stack[k][0] in names:
                    close(k)
                    return True
            return False

        def closed_later(name: str, at: int) -> bool:
            if name not in last_end:
                last_end[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}[\s/>]", source, re.I)), default=-1)
            return last_end[name] >= at

        def say(begin: int, end: int):
            nonlocal linked
            if end > begin and not hidden:
                run.append(source[begin:end])
                linked += (end - begin) if link else 0

        at, n = 0, len(source)
        while at < n:
            tag = source.find("<", at)
            if tag < 0:
                say(at, n)
                break
            follows = source[tag + 1 : tag + 2]
            if follows in ("!", "?") or (follows == "/" and not _NAME.match(source, tag)):
                say(at, tag)
                if source.startswith("<!--", tag):
                    if source.startswith((">", "->"), tag + 4):
                        at = source.index(">", tag + 4) + 1
                        continue
                    end = _COMMENT_END.search(source, tag + 4)
                    at = end.end() if end else n
                else:
                    end = source.find(">", tag)
                    at = end + 1 if end >= 0 else n
                continue
            m = _NAME.match(source, tag)
            if not m:  # no tag, just a mark
                say(at, tag + 1)
                at = tag + 1
                continue
            say(at, tag)
            rest = _REST.match(source, m.end())
            if not rest:  # the page ends inside a tag
                break
            at, name, ends = rest.end(), m[1].lower(), follows == "/"
            if name in RAW or name in RAW_IF_CLOSED:
                if not ends and (name in RAW or closed_later(name, at)):
                    end = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                    at = source.find(">", end.start()) + 1 if end else n
                    at = at or n
                continue
            if hidden:
                if ends and inner.get(name, 0):
                    inner[name] -= 1
                    hidden = hidden if inner[hidden] else ""
                    continue
                if not ((ends and opened.get(name, 0) > 0) or (not ends and hidden in CONTROLS and name in ENDS_CONTROL)):
                    if not ends and name not in VOID and source[at - 2] != "/":
                        inner[name] = inner.get(name, 0) + 1
                    continue
                hidden = ""  # a block around it ends, or one that can't be inside begins
            if name in HIDDEN:
                if not ends and source[at - 2] != "/" and (name in CONTROLS or closed_later(name, at)):
                    hidden, inner = name, {name: 1}
                continue
            if name == "a":
                link = 0 if ends else 1
                continue
            if name in INLINE:
                continue
            if name == "br":
                run.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if ends:
                if opened.get(name, 0) > 0:
                    close_nearest((name,))
                else:
                    flush()
                link = 0
                continue
            flush()
            link = 0
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            if name in CLOSES:
                close_nearest(*CLOSES[name])
            if len(stack) >= MAX_DEPTH:
                close(len(stack) - 1)
            kinds = _name_kinds(source[m.end() : at]) if at - m.end() > 1 else 0
            good = name in _GOOD_TAGS or kinds >> (len(_KINDS) + 1)
            bad = name in _BAD_TAGS or kinds & ((1 << (len(_KINDS) + 1)) - 1)
            near = -1 if bad else 1 if good else stack[-1][2]
            stack.append((name, self._add(_TAG.get(name, 0), kinds, stack[-1][1], len(stack), near), near))
            opened[name] = opened.get(name, 0) + 1
        close(0)
        self.pages += 1

    def features(self) -> np.ndarray:
        tag, kinds, parent, end, depth, near = (np.array(x, np.int64) for x in (self.tag, self.kinds, self.parent, self.end, self.depth, self.near))
        chars, links, page = (np.array(x, np.int64) for x in (self.chars, self.links, self.page))
        n = len(tag)
        self.arrays = parent, depth, end
        index = np.arange(n)
        total = lambda x: (s := np.r_[0, np.cumsum(x)])[end] - s[index]  # noqa: E731  sum over each subtree
        size, linked, count = total(chars), total(links), end - index
        first = np.flatnonzero(parent < 0)
        whole = np.maximum(size[first], 1)[page]
        before = np.r_[0, np.cumsum(chars)][:-1]
        before = before - before[first][page]
        up = np.maximum(parent, 0)
        children = np.bincount(parent[parent >= 0], minlength=n)
        order = np.lexsort((index, parent))
        start = np.r_[True, parent[order][1:] != parent[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = index - np.maximum.accumulate(np.where(start, index, 0))
        older = np.full(n, -1, np.int64)
        older[order[1:]] = np.where(start[1:], -1, order[:-1])
        siblings = np.where(parent < 0, 1, children[up])
        good = (tag == 1) | (tag == 2) | (kinds >> (len(_KINDS) + 1) > 0)
        bad = ((tag >= 3) & (tag <= 7)) | (kinds & ((1 << (len(_KINDS) + 1)) - 1) > 0)
        numbers = [
            np.log1p(size), linked / np.maximum(size, 1), size / whole, np.log1p(size / count), depth, np.log1p(children),
            rank / siblings, np.where(parent < 0, 1.0, size / np.maximum(size[up], 1)), before / whole, (tag < 0).astype(int), near,
            total(good) - good, total(bad) - bad, np.where(older >= 0, size[older] / whole, -1), np.where(parent < 0, 0, good[up] * 1 - bad[up] * 1), np.minimum(siblings, 30),
        ]
        hot = [(np.maximum(tag, 0) if tag_of == "own" else np.where(parent < 0, 0, np.maximum(tag, 0)[up])) == k for tag_of in ("own", "parent") for k in range(1, len(_TAGS) + 1)]
        hot += [(kinds >> k) & 1 for k in range(1, len(_KINDS) + 2)]
        return np.stack([np.asarray(x, np.float32) for x in numbers + hot], axis=1)

    def kept(self, logits: np.ndarray) -> np.ndarray:
        """The likeliest choice in which every kept node has a kept parent; a page's root is always kept."""
        parent, depth, end = self.arrays
        keep, drop = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)
        sums = np.r_[0, np.cumsum(drop)]
        none = sums[end] - sums[:-1]
        levels = [np.flatnonzero(depth == k) for k in range(int(depth.max(initial=0)) + 1)]
        below = np.zeros(len(parent))
        for at in reversed(levels[1:]):
            np.add.at(below, parent[at], np.maximum(keep[at] + below[at], none[at]))
        out = keep + below >= none
        out[parent < 0] = True
        for at in levels[1:]:
            out[at] &= out[parent[at]]
        return out


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> boosted_trees.BoostedTrees:
    """Trees trained on ``pages`` made-up pages; a node's label is whether its subtree holds main text."""
    maker, nodes = html_pages.Pages(seed), Nodes()
    for _ in range(pages):
        nodes.add_page(maker.page())
    marked = np.array([bool(t) and html_pages.OPEN in t for t in nodes.texts], np.int64)
    for k, text in enumerate(nodes.texts):
        if text:
            clean = text.replace(html_pages.OPEN, "").replace(html_pages.CLOSE, "")
            nodes.chars[k] = len(clean)
    x = nodes.features()
    end = np.array(nodes.end)
    sums = np.r_[0, np.cumsum(marked)]
    y = (sums[end] > sums[:-1]).astype(np.float64)
    real = np.array(nodes.parent) >= 0
    return boosted_trees.fit(x[real], y[real], np.ones(int(real.sum())))


@functools.lru_cache(1)
def page_model() -> boosted_trees.BoostedTrees:
    """The trees of MODEL_FILE, which :func:`train` made; ``python -m panelfactor.llm.html_extract`` writes it anew."""
    with np.load(MODEL_FILE) as f:
        return boosted_trees.BoostedTrees(f["features"], f["cuts"], f["values"], float(f["base"]))


def main_texts(pages: list[str | None], model: boosted_trees.BoostedTrees) -> list[str]:
    """Main text of each page: kept runs of text in page order, joined by one space."""
    nodes = Nodes()
    for source in pages:
        nodes.add_page(source or "")
    out: list[list[str]] = [[] for _ in pages]
    if pages:
        kept = nodes.kept(model.logits(nodes.features()))
        for k in np.flatnonzero(kept).tolist():
            if nodes.texts[k] is not None:
                out[nodes.page[k]].append(nodes.texts[k])
    return [" ".join(x) for x in out]


def extract(pages: DataFrame, html_column: str = "html", model: boosted_trees.BoostedTrees | None = None) -> DataFrame:
    """``pages`` without ``html_column``, plus ``text``: the main text by ``model`` (none: that of MODEL_FILE).

    Null or empty html, and pages without main text: empty text. Repeated rows alike; long pages are read
    whole; other columns stay (one called text is replaced). An empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or page_model())
    rest = [f for f in pages.schema if f.name not in (html_column, "text")]
    names = [f.name for f in rest]

    def run(batches):
        model = shared.value
        for batch in batches:
            column, texts, chunk, size = batch.column("_hx_html"), [], [], 0
            for cell in column:
                chunk.append(cell.as_py())
                size += len(chunk[-1] or "")
                if size >= CHUNK_CHARS:
                    texts += main_texts(chunk, model)
                    chunk, size = [], 0
            texts += main_texts(chunk, model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    slim = pages.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{html_column}`").cast("string").alias("_hx_html"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest]
    return slim.mapInArrow(run, ", ".join([*fields, "text string"]))


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    """Query: main text of every row of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))


if __name__ == "__main__":
    made = train()
    np.savez_compressed(MODEL_FILE, features=made.features.astype(np.int16), cuts=made.cuts, values=made.values, base=made.base)
