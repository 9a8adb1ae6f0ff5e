"""Main text of web pages: boosted trees over DOM nodes and a hierarchical decoding.

*Nodes* are the block elements of a page's tree; inline elements belong to the
block around them.  A table cell is a node of its own once a block begins in
it; the text of plain cells belongs to their row.  Scripts, styles and other
elements without readable text are left out while the page is read.

*Features* of a node: how much text it and its subtree hold, per element and
as a share of the page; link and form density; depth; place among its
siblings, their number, and how alike they are; which words of a fixed list
occur as tag or in class, id and role, of the node itself and of the elements
around it; and which cue ("comments", "share", a copyright sign) the short
first text of the node, or of an element around it, opens with.

*Trees* are boosted on labelled pages that this module writes from templates
(``training_pages``): articles among menus, headers, footers, sidebars, notices,
adverts, forms and comments, with sound and careless mark-up, in five families
of layouts (``FAMILIES``), four of them without any telling tag or class.  Their
number is a parameter.  The fitted trees, a few kilobytes, go to the tasks.

*Decoding*: every node is kept whole, dropped whole, or split, in which case
its children are decided one by one and its own text by its own score.  The
assignment with the largest sum of scores, less ``SPLIT_COST`` for each split
node, is found from the leaves up, so nothing inside a kept node is dropped
and nothing inside a dropped one is kept.

A page is read in time that grows with its length, whatever its mark-up; nodes
are held in typed arrays and their features are made a slice at a time.

Null pages count as empty and give the empty text.  Broken mark-up is read to
its end: unclosed elements end with their parent, stray end tags are passed
over.  Repeated rows give equal results; extra columns are not read.
"""

from __future__ import annotations

import functools
import html
import random
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqyield.llm.common import whole

# Element names by their role in HTML.
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s
samp small span strike strong sub sup time tt u var wbr
math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style template textarea title iframe svg canvas audio video select button head "
                   "annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe".split())
SPACE = frozenset("br td th img input".split())
CELLS = frozenset(["td", "th"])
#: Elements that a following one of the same list ends.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Words looked for in tags, classes, ids and roles.
LEXICON = """article main content post entry story body text paragraph section p h li ul ol dl table tr td div blockquote
pre figure nav navigation menu menubar breadcrumb pagination tabs header masthead banner title byline footer
contentinfo copyright legal sidebar aside complementary widget rail related recommended popular ad ads advert
advertisement adslot sponsor sponsored promo notice cookie consent gdpr alert popup modal overlay toast form search
login signup newsletter subscribe comment comments reply respond discussion disqus feedback share social follow
author tags meta noscript""".split()
_CODE = {w: i for i, w in enumerate(LEXICON)}
#: What the short first text of boilerplate opens with.
CUES = ["(?:[0-9]+ )?(?:reader )?(?:comments?|repl(?:y|ies)|responses|discussion)\\b|leave a (?:reply|comment)|join the conversation",
        "related|recommended|popular|trending|more (?:from|stories)|read (?:more|next)|you (?:may|might) also",
        "©|\\(c\\) |copyright|all rights reserved|powered by",
        "(?:this|our) (?:site|website)|we use cookies|cookies?\\b|by continuing|accept (?:all|cookies)",
        "subscribe|sign (?:up|in)|log ?in|register|newsletter|search\\b",
        "advert|sponsored|promot|\\bads?\\b", "share|follow us|tweet|print this|tags?:", "menu|skip to|you are here|home\\b"]
_CUE = re.compile("|".join(f"({cue})" for cue in CUES), re.I)
#: Longest first text that is looked at for a cue.
CUE_CHARS = 100
_WORDS = len(LEXICON) + len(CUES)
_HALF = (1 << 64) - 1

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)"""
                  r"""((?>[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+))>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
#: Read once a quote turned out to be open to the end of the page: a tag ends at the next ">".
_PLAIN_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>()()()""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WHITE = re.compile(r"[\x20\x09-\x0D]+")
_PIECE = re.compile(r"[a-z]+")
#: Marks that end a sentence or clause.
_STOPS = re.compile(r"[.!?;:,]")


@functools.lru_cache(maxsize=None)
def _ending(name: str) -> re.Pattern:
    """What ends an element that is not read; only called for the names of ``UNREAD``."""
    return re.compile({"head": r"</head\s*+>|(?=<body\b)"}.get(name, rf"</{re.escape(name)}(?![\w-])[^>]*+>"), re.I)


def _words(tag: str, attributes: str) -> int:
    """Set of the lexicon's words in a tag and its class, id and role, as bits."""
    found = {_CODE.get(re.sub(r"\d", "", tag))}
    for value in _ATTRIBUTE.findall(attributes):
        found.update(map(_CODE.get, _PIECE.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())))
    return sum(1 << x for x in found if x is not None)


_known_words = functools.lru_cache(maxsize=4096)(_words)
#: Longest attributes whose words are remembered.
_REMEMBERED = 300


def cue_bit(text: str) -> int:
    """The cue a short text opens with, as a bit above those of the lexicon; 0 if there is none."""
    found = _CUE.match(text) if len(text) <= CUE_CHARS else None
    return 1 << (len(LEXICON) + found.lastindex - 1) if found else 0


def _ints() -> array:
    return array("q")


def _bits() -> array:
    return array("Q")


@dataclass
class Page:
    """Block elements in page order, and the text runs that hold more than white space."""
    parent: array = field(default_factory=_ints)
    end: array = field(default_factory=_ints)      # one past the last node of the subtree
    depth: array = field(default_factory=_ints)
    place: array = field(default_factory=_ints)    # number among the siblings
    children: array = field(default_factory=_ints)
    tag: array = field(default_factory=_ints)      # number of the tag in ``names``
    links: array = field(default_factory=_ints)    # characters inside links
    fields: array = field(default_factory=_ints)   # form controls
    mine: tuple = field(default_factory=lambda: (_bits(), _bits()))   # words of the node, low and high half
    path: tuple = field(default_factory=lambda: (_bits(), _bits()))   # words of all elements around it
    names: dict = field(default_factory=dict)
    run_node: array = field(default_factory=_ints)
    run_text: list = field(default_factory=list)

    def add(self, parent: int, tag: str, words: int) -> int:
        node = len(self.parent)
        self.parent.append(parent)
        self.end.append(0)
        self.depth.append(self.depth[parent] + 1 if node else 0)
        self.place.append(self.children[parent] if node else 0)
        if node:
            self.children[parent] += 1
        self.children.append(0)
        self.tag.append(self.names.setdefault(tag, len(self.names)))
        self.links.append(0)
        self.fields.append(0)
        low, high = self.mine
        self.path[0].append(self.path[0][parent] | low[parent] if node else 0)
        self.path[1].append(self.path[1][parent] | high[parent] if node else 0)
        low.append(words & _HALF)
        high.append(words >> 64)
        return node


def parse(source: str) -> Page:
    """Read a page; a run of text also ends where a block begins or ends inside its node.

    Every step looks at the innermost open block, at counts of open elements or
    at what it then closes, so the time grows with the length of the page.
    """
    page = Page()
    page.add(-1, "#page", 0)
    spoken = bytearray(1)   # nodes whose subtree holds text
    blocks = [("#page", 0, [])]   # open blocks: name, node, and the inline elements open in it
    inside: list = [{}]           # how often each inline element is open in each open block
    cells = [None]                # attributes of a cell begun in each open block, as long as it holds no block
    opened: dict = {}             # number of open blocks by name
    tables: list = []             # places in ``blocks`` of tables, rows and cells
    unended: set = set()          # unread elements without an end tag ahead
    at, anchors, buffer = 0, 0, []

    def flush():
        if not buffer:
            return
        text = _WHITE.sub(" ", html.unescape("".join(buffer))).strip(" ")
        buffer.clear()
        if not text:
            return
        node = blocks[-1][1]
        page.run_node.append(node)
        page.run_text.append(text)
        if not spoken[node]:
            cue = cue_bit(text)
            while node and not spoken[node]:
                spoken[node] = 1
                if cue:
                    page.mine[0][node] |= cue & _HALF
                    page.mine[1][node] |= cue >> 64
                node = page.parent[node]

    def add(text):
        if text:
            buffer.append(text)
            if anchors:
                page.links[blocks[-1][1]] += len(text)

    def close(down_to):
        """Close blocks until ``down_to`` of them are open."""
        nonlocal anchors
        while len(blocks) > down_to:
            flush()
            name, node, inline = blocks.pop()
            anchors -= inside.pop().get("a", 0)
            cells.pop()
            opened[name] -= 1
            page.end[node] = len(page.parent)
            if tables and tables[-1] == len(blocks):
                tables.pop()

    def begin(name, attributes):
        flush()
        words = (_known_words if len(attributes) <= _REMEMBERED else _words)(name, attributes)
        node = page.add(blocks[-1][1], name, words)
        spoken.append(0)
        if attributes.endswith("/"):
            page.end[node] = node + 1
            return
        if name in ("table", "tr") or name in CELLS:
            tables.append(len(blocks))
        blocks.append((name, node, []))
        inside.append({})
        cells.append(None)
        opened[name] = opened.get(name, 0) + 1

    n, last, form = len(source), source.rfind(">") + 1, _TAG
    while at < last:
        match = form.search(source, at, last)
        if match is None:
            break
        add(source[at:match.start()])
        at = match.end()
        if source.startswith("<!--", match.start()) and not source.endswith("-->", match.start() + 4, at):
            at = n
        if match[5]:
            form = _PLAIN_TAG
        name = match[2] or match[5]
        if not name:
            continue
        closing, name, attributes = match[1] or match[4], name.lower(), match[3] or match[6] or ""
        if closing:
            if name in CELLS and cells[-1] is not None:
                cells[-1] = None
            elif name in INLINE:
                if inside[-1].get(name):   # an inline end tag does not end a block
                    while True:
                        ended = blocks[-1][2].pop()
                        inside[-1][ended] -= 1
                        anchors -= ended == "a"
                        if ended == name:
                            break
            elif opened.get(name):
                k = len(blocks) - 1
                while blocks[k][0] != name:
                    k -= 1
                close(k)
            if name in SPACE:
                add(" ")
            continue
        if name in VOID:
            if name in ("input", "embed"):
                page.fields[blocks[-1][1]] += 1
            if name in SPACE or name == "hr":
                add(" ")
            continue
        if name in UNREAD and not attributes.endswith("/"):
            if name in ("select", "textarea", "button"):
                page.fields[blocks[-1][1]] += 1
            over = None if name in unended else _ending(name).search(source, at)
            if over:
                at = over.end()
            else:
                unended.add(name)
                at = n if name in RAW else at
            continue
        if name in INLINE:
            if not attributes.endswith("/"):
                blocks[-1][2].append(name)
                inside[-1][name] = inside[-1].get(name, 0) + 1
                anchors += name == "a"
            continue
        if name in ("html", "body", "tbody", "thead", "tfoot") and not attributes:
            continue
        if name in CELLS or name == "tr":
            # A cell or row ends what is open in its row, and a row the one before it.
            while tables and (blocks[tables[-1]][0] in CELLS or name == "tr" and blocks[tables[-1]][0] == "tr"):
                close(tables[-1])
            if tables:
                close(tables[-1] + 1)
            if name in CELLS:
                add(" ")
                cells[-1] = (name, attributes.rstrip("/"))
                continue
        # A block ends an open paragraph, and a list item the one before it.
        while blocks[-1][0] == "p" or name in ENDED_BY.get(blocks[-1][0], ()):
            close(len(blocks) - 1)
        if cells[-1] is not None:
            cell, cells[-1] = cells[-1], None
            begin(*cell)
        begin(name, attributes)
    tail = source.find("<!--", at)
    add(source[at:] if tail < 0 else source[at:tail])
    close(1)
    flush()
    page.end[0] = len(page.parent)
    return page


def block_texts(page: Page) -> list[tuple[int, str]]:
    """(node, text) of each run that holds more than white space, in page order."""
    return list(zip(page.run_node, page.run_text))


#: Nodes whose features are held at once.
SLICE = 1 << 16
#: Features that are numbers.
_NUMBERS = 22


class Features:
    """Features of all nodes of some pages, one after the other: numbers, and the words as bits."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        base = np.cumsum(sizes) - sizes
        total = int(sizes.sum())

        def flat(get, dtype=np.int64):
            out = np.empty(total, dtype)
            for b, p in zip(base, pages):
                out[b:b + len(p.parent)] = get(p)
            return out

        shift = np.repeat(base, sizes)
        parent = flat(lambda p: p.parent)
        root = parent < 0
        up = np.where(root, np.arange(total), parent + shift)
        self.parent, self.end = np.where(root, -1, up), flat(lambda p: p.end) + shift
        del parent
        chars, stops, runs = (np.zeros(total, np.float32) for _ in range(3))
        for b, p in zip(base, pages):
            for node, text in zip(p.run_node, p.run_text):
                chars[b + node] += len(text)
                stops[b + node] += len(_STOPS.findall(text))
                runs[b + node] += 1
        self.has_text = runs > 0

        def below(x):
            upto = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
            return (upto[self.end] - upto[:-1]).astype(np.float32)

        of_tag = lambda name: flat(lambda p: np.asarray(p.tag) == p.names.get(name, -1), np.float32)
        size, nodes = below(chars), (self.end - np.arange(total)).astype(np.float32)
        text = np.maximum(size, 1)
        children = flat(lambda p: p.children)
        siblings = np.where(root, 0, children[up]).astype(np.float32)
        place = flat(lambda p: p.place, np.float32)
        sibling_chars = np.bincount(up, np.where(root, 0, size), total)[up].astype(np.float32)
        names: dict = {}
        tags = flat(lambda p: np.array([names.setdefault(t, len(names)) for t in p.names])[p.tag])
        _, back, alike = np.unique(up * (len(names) + 1) + tags, return_inverse=True, return_counts=True)
        alike = alike[back].astype(np.float32)
        del back, tags
        self.dense = np.empty((total, _NUMBERS), np.float32)
        at = iter(range(_NUMBERS))

        def put(column):
            self.dense[:, next(at)] = column

        put(np.log1p(chars))
        put(np.log1p(size))
        put(np.log1p(size / nodes))
        put(size / np.maximum(np.repeat(size[base], sizes), 1))
        put(np.minimum(below(flat(lambda p: p.links)) / text, 2))
        put(below(stops) / text)
        put(np.minimum(below(flat(lambda p: p.fields)), 9))
        put(np.log1p(below(of_tag("p"))))
        put(np.log1p(below(of_tag("li"))))
        put(np.log1p(nodes))
        put(flat(lambda p: p.depth))
        put(np.minimum(place, 99))
        put(np.minimum(siblings, 99))
        put(place / np.maximum(siblings, 1))
        put(alike / np.maximum(siblings, 1))
        put(np.log1p(sibling_chars / np.maximum(siblings, 1)))
        put(size / np.maximum(sibling_chars, 1))
        put(np.log1p(runs))
        # What holds the node, and what holds that.
        share, linked = self.dense[:, 3].copy(), self.dense[:, 4].copy()
        put(share[up])
        put(share[up[up]])
        put(linked[up])
        put(self.dense[up, 5])
        self.bits = [flat(lambda p, k=k, h=h: (p.mine, p.path)[k][h], np.uint64) for k in (0, 1) for h in (0, 1)]

    def __len__(self) -> int:
        return len(self.parent)

    def rows(self, start: int, stop: int) -> np.ndarray:
        """The features of some nodes: a row each."""
        out = np.empty((stop - start, _NUMBERS + 2 * _WORDS), np.float32)
        out[:, :_NUMBERS] = self.dense[start:stop]
        for k in (0, 1):
            halves = np.column_stack([h[start:stop] for h in self.bits[2 * k:2 * k + 2]]).astype("<u8").view(np.uint8)
            at = _NUMBERS + k * _WORDS
            out[:, at:at + _WORDS] = np.unpackbits(halves, axis=1, count=_WORDS, bitorder="little")
        return out


@dataclass
class Boosted:
    """Boosted regression trees of one depth on binned features, for the logistic loss."""
    edges: list
    trees: list
    start: float
    rate: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        used = sorted({int(f) for feature, _, _ in self.trees for f in feature})
        at = {f: k for k, f in enumerate(used)}
        bins = [np.searchsorted(self.edges[f], x[:, f], side="left") for f in used]
        bins = np.array(bins) if bins else np.zeros((0, len(x)), np.int64)
        out = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            place = np.array([at[int(f)] for f in feature])
            node = np.zeros(len(x), np.int64)
            while node[0] < len(feature) if len(node) else False:
                node = 2 * node + 1 + (bins[place[node], np.arange(len(x))] > cut[node])
            out += self.rate * value[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 5, rate: float = 0.25, bins: int = 32,
          ridge: float = 1.0) -> Boosted:
    """Fit trees by gradient boosting with histograms; every tree is grown to ``depth``.

    The histograms of features with two values are one product with the gradients.
    """
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:]))
        edges.append(values[:-1])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(edges, [], float(np.log(share / (1 - share))), rate)
    b = model.binned(x)
    many = np.array([k for k, e in enumerate(edges) if len(e) > 1], np.int64)
    two = np.array([k for k, e in enumerate(edges) if len(e) == 1], np.int64)
    width = max(len(e) for e in edges) + 1
    keys = b[:, many].astype(np.int64) + np.arange(len(many)) * width
    flags = b[:, two].astype(np.float32)
    score = np.full(len(y), model.start)
    inner = 2 ** depth - 1

    def gains(g, h, all_g, all_h):
        """What a cut gains whose lower side has the sums ``g`` and ``h``."""
        return g ** 2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g ** 2 / (all_h + ridge)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = y - p, p * (1 - p)
        both = np.column_stack([gradient, curve]).astype(np.float32)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        for at in range(inner):
            rows = np.nonzero(node == at)[0]
            if len(rows) > 1:
                all_g, all_h = gradient[rows].sum(), curve[rows].sum()
                options = []
                if len(many):
                    k, size = keys[rows].ravel(), len(many) * width
                    g = np.bincount(k, np.repeat(gradient[rows], len(many)), size).reshape(-1, width).cumsum(axis=1)
                    h = np.bincount(k, np.repeat(curve[rows], len(many)), size).reshape(-1, width).cumsum(axis=1)
                    gain = gains(g, h, all_g, all_h)
                    best = int(gain.argmax())
                    options.append((float(gain.flat[best]), int(many[best // width]), best % width))
                if len(two):
                    g, h = both[rows].T @ flags[rows]
                    gain = gains(all_g - g, np.maximum(all_h - h, 0), all_g, all_h)
                    best = int(gain.argmax())
                    options.append((float(gain[best]), int(two[best]), 0))
                gained, column, value = max(options, default=(0.0, 0, 0))
                if gained > 1e-6:
                    feature[at], cut[at] = column, value
            node[rows] = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        leaf = node - inner
        value = np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, curve, inner + 1) + ridge)
        model.trees.append((feature, cut, value))
        score += rate * value[leaf]
    return model


#: Labelled pages the trees are boosted on.
TRAINING_PAGES = 800
#: Layouts of the training pages and how many of ten have them: elements and classes that name their role, nested
#: blocks without classes, blocks with meaningless classes, nested tables, everything directly in the body.
FAMILIES = {"named": 5, "plain": 2, "opaque": 1, "tables": 1, "bare": 1}

#: What splitting a node costs, in units of the scores.
SPLIT_COST = 0.5


def decode(score: np.ndarray, parent: np.ndarray, end: np.ndarray, has_text: np.ndarray,
           split_cost: float = SPLIT_COST) -> np.ndarray:
    """Which nodes' own text is kept: the best assignment without contradictions down the tree.

    ``parent`` and ``end`` are as lists in page order: parents come before their children.
    """
    n = len(score)
    upto = np.concatenate([[0.0], np.cumsum(score)])
    whole_ = upto[end] - upto[:-1]
    split = np.where(has_text, np.abs(score), 0.0) - split_cost
    plain, around = np.abs(whole_).tolist(), parent.tolist()
    sums = split.tolist()
    for i in range(n - 1, -1, -1):
        if around[i] >= 0:
            sums[around[i]] += max(plain[i], sums[i])
    kept, state = np.zeros(n, bool), np.zeros(n, np.int8)   # 1: kept whole, -1: dropped whole, 0: split
    for i in range(n):
        above = state[around[i]] if around[i] >= 0 else 0
        if above:
            state[i] = above
        elif plain[i] >= sums[i]:
            state[i] = 1 if whole_[i] > 0 else -1
        kept[i] = state[i] > 0 or (state[i] == 0 and score[i] > 0)
    return kept


#: Wraps main text while a training page is written; a private-use character.
MARK = "\ue000"


def training_pages(count: int = TRAINING_PAGES, seed: int = 11, families: tuple[str, ...] = tuple(FAMILIES)) -> list[str]:
    """Labelled pages as mark-up, of the given families in the shares of ``FAMILIES``.

    Main text is wrapped in ``MARK``; ``_labelled`` reads the marks off again.
    """
    rng = random.Random(seed)
    pick = lambda xs: xs[int(rng.random() * len(xs))]
    syllables = "an en in on re ti st ou la de mi ver al to ra si no che que lo pa ä é ung ción tion the".split()

    def word():
        return "".join(pick(syllables) for _ in range(rng.randrange(1, 4)))

    def words(lo, hi):
        noise = pick(["", "", "", "", "***", "!!", " |"])
        marks = pick([0, 0, 0.05, 0.15])   # how often a word ends a clause or sentence
        return " ".join(word() + noise + (pick([",", ".", ".", ";", "?"]) if rng.random() < marks else "")
                        for _ in range(rng.randrange(lo, hi))).capitalize() + pick([".", ".", "", "&amp;", "!"])

    def links(lo, hi):
        return [f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randrange(lo, hi))]

    boiler = {
        "menu": lambda: pick(['<nav><ul>{}</ul></nav>', '<div class="menu"><ul>{}</ul></div>', '<nav id="navigation">{}</nav>',
                              '<ul class="breadcrumb">{}</ul>', '<div role="navigation"><ul>{}</ul></div>']).format("".join(links(2, 9))),
        "header": lambda: pick(['<header><h1>{}</h1><p>{}</p></header>', '<div id="masthead"><h2>{}</h2><div>{}</div></div>',
                                '<div class="banner header">{} <b>{}</b></div>']).format(words(1, 5), words(2, 9)),
        "footer": lambda: pick(['<footer>&copy; {}.example &middot; {}</footer>', '<footer><p>{}</p><p>{}</p></footer>',
                                '<div class="footer legal"><p>&copy; {}</p> {}</div>', '<div id="copyright">{} {}</div>']).format(words(1, 4), words(2, 14)),
        "sidebar": lambda: pick(['<aside><h3>{}</h3><ul>{}</ul></aside>', '<div class="sidebar"><h3>{}</h3><p>{}</p></div>',
                                 '<div class="widget related"><h4>{}</h4><ul>{}</ul></div>',
                                 '<aside class="rail"><p>{}</p><p>{}</p></aside>']).format(words(1, 5), pick(["".join(links(2, 7)), words(4, 30)])),
        "advert": lambda: pick(['<div class="ad">{}</div>', '<div class="advertisement"><p>{}</p></div>', '<div id="ad-slot-1"><span>{}</span></div>',
                                '<div class="sponsored promo"><a href="/x">{}</a></div>', '<section class="ads">{}</section>']).format(words(2, 25)),
        "notice": lambda: pick(['<div class="cookie-notice">{}</div>', '<div id="consent" role="alert"><p>{}</p></div>',
                                '<div class="popup newsletter"><p>{}</p></div>', '<div class="notice">{}</div>']).format(words(3, 30)),
        "form": lambda: pick(['<form><label>{}</label><input name="q"><button>Go</button></form>', '<form class="search"><p>{}</p><input></form>',
                              '<div class="login form"><form><div>{}</div><select><option>1</option></select></form></div>']).format(words(1, 9)),
        "comments": lambda: pick(['<section class="comments"><h3>{}</h3>{}</section>', '<div id="comments"><h2>{}</h2>{}</div>',
                                  '<ol class="comment-list"><li>{}</li>{}</ol>']).format(words(1, 4), "".join(
                                      pick(['<div class="comment"><p>{}</p></div>', '<p>{}</p>', '<div class="reply"><b>x</b> {}</div>']).format(
                                          words(3, 40)) for _ in range(rng.randrange(1, 5)))),
        "headed comments": lambda: pick(['<section><h2>{}</h2>{}</section>', '<h3>{}</h3><div class="comment-list">{}</div>',
                                         '<div><h2>{}</h2>{}</div>']).format(pick(opening["comments"]), remarks()),
        "noscript": lambda: f"<noscript>{pick(['Please enable JavaScript', words(2, 9)])}</noscript>",
        "share": lambda: pick(['<div class="share social"><ul>{}</ul></div>', '<div class="tags">{}</div>']).format("".join(links(2, 5))),
    }

    opening = {
        "comments": ["Comments", "3 Comments", "Reader comments", "Leave a reply", "12 Replies", "Responses", "Discussion",
                     "Join the conversation"],
        "sidebar": ["Related", "Related articles", "Popular", "Most recommended", "Recommended for you", "Trending", "Read more",
                    "You may also like"],
        "footer": ["© {} example", "(c) 2020 {}", "Copyright 2021 {}", "&copy; {} &middot; imprint", "All rights reserved {}"],
        "notice": ["This site uses cookies. {}", "We use cookies {}", "Our website {} cookies", "By continuing {}"],
        "form": ["Subscribe", "Sign up", "Log in", "Newsletter", "Search"],
        "advert": ["Advertisement", "Sponsored", "Advert", "Promoted"], "share": ["Share", "Share this", "Follow us", "Tags:"],
        "menu": ["Menu", "Home", "Skip to content", "You are here"],
    }

    def remarks():
        return "".join(pick(["<p>{}</p>", "<div>{}</div>", "<div><b>x</b><p>{}</p></div>"]).format(words(3, 40))
                       for _ in range(rng.randrange(1, 6)))

    def unnamed(kind):
        """Boilerplate whose tags and classes do not tell what it is."""
        first = pick(opening.get(kind, [""])).format(word())
        row = lambda sign: sign.join(f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.randrange(3, 9)))
        return {
            "menu": lambda: pick([f"<ul>{''.join(links(3, 9))}</ul>", row(" | "), row(" "), row("<br>"), f"{first} {row(' ')}"]),
            "header": lambda: pick([f'<a href="/"><b>{words(1, 4)}</b></a>', f'<a href="/"><img src="x"></a> {words(1, 4)}',
                                    f'<div><a href="/">{words(1, 3)}</a></div><div>{row(" ")}</div>']),
            "footer": lambda: pick([first, f"<p>{first}</p>", f"{row(' | ')}<p>{first}</p>", f"<div>{first}</div><div>{row(' ')}</div>"]),
            "sidebar": lambda: pick(["<h3>{}</h3><ul>{}</ul>", "<b>{}</b><ul>{}</ul>", "<div>{}</div><ul>{}</ul>"]).format(
                first, "".join(links(2, 7))),
            "advert": lambda: pick([f"{first}<br><a href='/x'>{words(2, 9)}</a>", f"<a href='/x'>{words(2, 12)}</a>",
                                    f"<p>{first}</p><p>{words(2, 20)}</p>"]),
            "notice": lambda: pick([first.replace("{}", "") + " " + words(2, 14), f"<p>{first} {words(2, 14)}</p>"]),
            "form": lambda: f"<form>{first} <input name=q><button>Go</button></form>",
            "comments": lambda: pick(["<h3>{}</h3>{}", "<div>{}</div>{}", "<p><b>{}</b></p>{}"]).format(first, remarks()),
            "share": lambda: pick([f"{first} {row(' ')}", f"<p>{first}</p><ul>{''.join(links(2, 5))}</ul>"]),
        }[kind]()

    def unnamed_page(family, inside, before, after):
        box = lambda x: (f'<div class="{pick(["x", "css-", "sc-", "q", "jsx"])}{rng.randrange(99)}">{x}</div>'
                         if family == "opaque" else f"<div>{x}</div>")
        article = "".join(inside)
        if family == "bare":
            # Boilerplate of several blocks needs one around it to be told from the article.
            return "".join([*map(box, before), article, *map(box, after)])
        if family == "tables":
            cell = lambda x, more="": f"<td{more}>{x}</td>"
            rows = ["".join(cell(x) for x in before[:1]), "".join(
                [cell("".join(map(pick([box, str]), before[1:])), ' width="20%"') if before[1:] else "",
                 cell(pick([article, box(article), f"<table><tr><td>{article}</td></tr></table>"]), ' valign="top"'),
                 cell("".join(map(box, after[:-1]))) if after[:-1] else ""]), "".join(cell(box(x)) for x in after[-1:])]
            return '<table width="100%" border="0">' + "".join(f"<tr>{r}</tr>" for r in rows if r) + "</table>"
        article = box(article)
        for _ in range(rng.randrange(0, 3)):
            article = box(article + (box(after.pop(0)) if after and rng.random() < 0.3 else ""))
        return "".join([*map(box, before), article, *map(box, after)])

    def paragraph(sizes, form):
        text = MARK + words(*pick(sizes)) + MARK
        if form:
            return form.format(text)
        return pick(["<p>{}</p>"] * 6 + ["<p><b>{}<br>", "<p>{}", "<p><em>{}</em></p>", '<p class="text">{}</p>', "<blockquote>{}</blockquote>",
                                         "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<pre>{}</pre>"]).format(text)

    pages, share = [], [FAMILIES[f] for f in families]
    for _ in range(count):
        family = rng.choices(families, share)[0]
        sizes = pick([[(1, 4), (4, 30), (20, 120), (60, 300)]] * 2 + [[(1, 4), (2, 9), (4, 16)]])
        form = pick([None] * 7 + ["<p>{}</p>"] * 4 + ["<div>{}</div>"] * 2 + ["{}<br><br>"]) if family != "named" else None
        inside = [paragraph(sizes, form) for _ in range(int(pick([1, 1, 1, 2, 3, 5, 8, 13, 25])))]
        if rng.random() < 0.8:
            # Some headings begin like boilerplate.
            cue = pick(pick(list(opening.values()))).format(word()) + " " if rng.random() < 0.04 else ""
            inside.insert(0, f"<h1>{MARK}{cue}{words(1, 12)}{MARK}</h1>")
        if family != "named":
            if len(inside) < 4:   # where nothing is named, the article has to be the longer part
                inside += [paragraph([(10, 40), (20, 120)], form or "<p>{}</p>") for _ in range(3)]
            before = [unnamed(k) for k in ("header", "menu", "advert", "notice", "form", "share") if rng.random() < 0.45]
            after = [unnamed(k) for k in ("share", "comments", "sidebar", "advert", "form", "footer", "notice") if rng.random() < 0.45]
            pages.append(f"<html><head><title>{words(1, 9)}</title></head><body>"
                         + unnamed_page(family, inside, before, after) + pick(["</body></html>", ""]))
            continue
        if rng.random() < 0.4:
            for _ in range(rng.randrange(1, 3)):
                inside.insert(rng.randrange(1, len(inside) + 1),
                              boiler[pick(["advert", "form", "notice", "share", "sidebar", "comments", "menu", "headed comments", "noscript"])]())
        article = pick(["<article>{}</article>"] * 5 + ["<main>{}</main>", "<main><article>{}</article></main>",
                        '<div class="post-content">{}</div>', '<div id="content">{}</div>', '<div class="story body">{}</div>',
                        '<section class="entry">{}</section>', '<div role="main"><div class="text">{}</div></div>',
                        "<article><div>{}</div></article>"]).format("".join(inside))
        before = [boiler[k]() for k in ("menu", "header", "advert", "notice", "form", "share") if rng.random() < 0.45]
        after = [boiler[k]() for k in ("comments", "sidebar", "advert", "share", "form", "footer", "notice") if rng.random() < 0.45]
        body = "".join([*before, article, *after])
        if rng.random() < 0.25:
            body = f'<div class="{pick(["page", "wrapper", "container"])}">{body}</div>'
        pages.append(f'<!DOCTYPE html><html><head><title>{words(1, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script>'
                      f'</head><body>{body}' + pick(["</body></html>", ""]))
    return pages


def _labelled(source: str) -> tuple[Page, np.ndarray]:
    """A training page without its marks, and for each node 1 (its own text is main), 0 (not) or -1 (no text)."""
    marked = parse(source)
    label = np.full(len(marked.parent), -1)
    for node, text in block_texts(marked):
        label[node] = MARK in text
    return parse(source.replace(MARK, "")), label


@functools.lru_cache(maxsize=4)
def fit(count: int = TRAINING_PAGES, seed: int = 11, families: tuple[str, ...] = tuple(FAMILIES)) -> Boosted:
    """Boost on ``count`` labelled pages of the given families."""
    labelled = [_labelled(source) for source in training_pages(count, seed, families)]
    made = Features([p for p, _ in labelled])
    y = np.concatenate([y for _, y in labelled])
    return boost(made.rows(0, len(made))[y >= 0], y[y >= 0].astype(float))


def main_texts(sources: list[str], model: Boosted) -> list[str]:
    """The main text of each page: its kept blocks, joined by two line ends."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    made = Features(pages)
    score = np.concatenate([model.logits(made.rows(k, min(k + SLICE, len(made)))) for k in range(0, len(made), SLICE)])
    score = np.clip(score, -6, 6)
    score[~made.has_text] = 0.0   # what a node without text of its own is worth, its children say
    parent, end, has_text = made.parent, made.end, made.has_text
    del made
    kept = decode(score, parent, end, has_text)
    out, base = [], 0
    for page in pages:
        out.append("\n\n".join(text for node, text in zip(page.run_node, page.run_text) if kept[base + node]))
        base += len(page.parent)
    return out


def extract(pages: DataFrame, html_col: str = "html", model: Boosted | None = None, name: str = "text",
            keep: tuple[str, ...] = ("page_id", "url"), batch_chars: int = 1 << 21) -> DataFrame:
    """The columns ``keep`` of each page, its main text, and the text's length ``n_chars``."""
    trees = pages.sparkSession.sparkContext.broadcast(model or fit())
    source = pages.select(*keep, whole(html_col).alias(name))

    def run(batches):
        for batch in batches:
            held, size, out = [], 0, []
            for value in batch.column(batch.num_columns - 1):
                held.append(value.as_py())
                size += len(held[-1])
                if size > batch_chars:
                    out += main_texts(held, trees.value)
                    held, size = [], 0
            out += main_texts(held, trees.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())],
                                             names=batch.schema.names)

    return source.mapInArrow(run, source.schema).withColumn("n_chars", F.char_length(name).cast("long"))
