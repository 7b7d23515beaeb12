"""Main text of HTML pages: boosted trees over DOM-node features, decoded along the tree."""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 1000
TREES, DEPTH, BINS, RATE = 160, 5, 32, 0.12
TOKENS = 1 << 18
BATCH_CHARS = 1 << 19
ROWS = 1 << 16
AGAINST = -1.0

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIP = frozenset("script style template noscript iframe noembed noframes object svg canvas audio video select button option textarea title head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div body html td th form main aside nav header footer".split())
TAGS = ("article", "main", "section", "div", "p", "ul", "li", "nav", "footer", "header", "aside", "form", "table", "blockquote", "pre", "body", "html", "h1", "h2", "h3")

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[A-Za-z](?:[^>="']++|=\s*+(?:"[^"]*"|'[^']*')?+|["'])*+>""", re.S)
OPENS = re.compile(r"</?[A-Za-z]|<[!?]")
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTR = re.compile(r"""(?<![\w:.@-])([A-Za-z_:@][\w:.@-]*+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LONG_NUMBER = re.compile(r"&#0*+([0-9]*+);?")


STOPS = SCOPE | frozenset(SELF_CLOSING) | {"p"}
LINK, PARAGRAPH, INPUT, CONTROLS = "a", "p", "input", ("select", "button", "textarea")
SPACES = np.zeros(0x3001, bool)
SPACES[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


class Dom:
    """The elements and texts of some pages, in page order, as arrays of numbers.

    Element ``i`` has the elements ``i + 1`` to ``end[i] - 1`` under it and ``text_at[i]``
    texts before it; a page begins with a root. A text is a stretch of ``source`` (a line
    break has none) with its element, and ``mark`` counts the blocks begun or ended before
    it, so texts with equal marks stand in one block."""

    def __init__(self, source: str):
        self.source = source
        self.names: dict[str, int] = {}
        self.tag, self.parent, self.end, self.depth, self.text_at, self.opens, self.closes = (array("i") for _ in range(7))
        self.text_start, self.text_end, self.owner, self.mark = (array("i") for _ in range(4))
        self.roots: list[int] = []
        self.blocks = 0

    def element(self, tag: str, parent: int, depth: int, opens: int, closes: int) -> int:
        at = len(self.tag)
        number = self.names.get(tag)
        if number is None:
            number = self.names[tag] = len(self.names)
        self.tag.append(number)
        self.parent.append(parent)
        self.end.append(at + 1)
        self.depth.append(depth)
        self.text_at.append(len(self.owner))
        self.opens.append(opens)
        self.closes.append(closes)
        return at

    def text(self, start: int, end: int, owner: int) -> None:
        self.text_start.append(start)
        self.text_end.append(end)
        self.owner.append(owner)
        self.mark.append(self.blocks)

    def tags_in(self, group) -> np.ndarray:
        """Whether each element's tag is in ``group``."""
        return np.array([t in group for t in self.names], bool)[np.frombuffer(self.tag, np.int32)]

    def within(self, chosen: np.ndarray) -> np.ndarray:
        """How many of the ``chosen`` elements each element is or lies in."""
        at = np.flatnonzero(chosen)
        n = len(self.tag) + 1
        steps = np.bincount(at, minlength=n) - np.bincount(np.frombuffer(self.end, np.int32)[at], minlength=n)
        return np.cumsum(steps)[:-1]


def parse(pages: list[str]) -> Dom:
    """The pages' elements and texts. Unclosed, misnested and stray tags are mended in the
    usual way; comments and declarations are left out; raw text holds no tags. From a tag
    on that nothing closes, a page is text. The time grows with the pages, whatever their
    tags: every step is constant or closes elements for good."""
    dom, at = Dom("".join(pages)), 0
    for p in pages:
        _page(dom, at, at + len(p))
        at += len(p)
    return dom


def _page(dom: Dom, at: int, n: int) -> None:
    source, names, find, token, named = dom.source, dom.names, dom.source.find, TOKEN.match, NAME.match
    root = dom.element("#root", len(dom.tag), 0, at, at)
    dom.roots.append(root)
    # of the open elements: number, tag, place of the open p that a block would close, and of
    # the nearest one, itself included, at which a search for what to close goes on
    open_, tags, paragraph, stop = array("i", [root]), ["#root"], array("i", [-1]), array("i", [0])
    opened: dict[str, int] = {}
    text, element, add_text = at, dom.element, dom.text

    def close(place: int) -> None:
        count, end = len(dom.tag), dom.end
        for k in range(place, len(open_)):
            tag = tags[k]
            opened[tag] -= 1
            dom.blocks += tag in BLOCK
            end[open_[k]] = count
        del open_[place:], tags[place:], paragraph[place:], stop[place:]

    while (at := find("<", at, n)) >= 0:
        m = token(source, at, n)
        if m is None:
            if OPENS.match(source, at, n):
                break
            at += 1
            continue
        if at > text:
            add_text(text, at, open_[-1])
        begins, at = at, m.end()
        text = at
        first = source[begins + 1]
        if first in "!?":
            continue
        name = named(source, begins)
        tag = name[1].lower()
        if first == "/":
            if opened.get(tag, 0) > 0:
                place = len(tags) - 1
                while tags[place] != tag:
                    place -= 1
                close(place)
            continue
        if tag in CLOSES_P and paragraph[-1] >= 0:
            close(paragraph[-1])
        if ends := SELF_CLOSING.get(tag):
            up = stop[-1]
            while up and tags[up] not in ends and tags[up] not in SCOPE:
                up = stop[up - 1]
            cells = ("td", "th") if tag in ("td", "th", "tr") else ()
            while up and tags[up] in ends and (tags[up] not in SCOPE or tags[up] in cells):
                close(up)
                up -= 1
        node = element(tag, open_[-1], len(open_), name.end(), at)
        if tag in BLOCK:
            dom.blocks += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at, n)
            last = end.start() if end else n
            if last > at:
                dom.text(at, last, node)
            close_at = source.find(">", last, n)
            at = text = n if end is None or close_at < 0 else close_at + 1
        elif tag in VOID or source[at - 2] == "/":
            if tag == "br":
                dom.text(-1, -1, open_[-1])
            dom.blocks += tag in BLOCK
        else:
            place = len(open_)
            open_.append(node)
            tags.append(tag)
            paragraph.append(place if tag == "p" else -1 if tag in SCOPE else paragraph[-1])
            stop.append(place if tag in STOPS else stop[-1])
            opened[tag] = opened.get(tag, 0) + 1
    if text < n:
        dom.text(text, n, open_[-1])
    opened["#root"] = 1
    close(0)


def unescape(text: str) -> str:
    """Character references decoded. A number of thousands of digits, which the library
    function refuses to read, is U+FFFD like any other that names nothing."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = LONG_NUMBER.sub(lambda m: m[0] if len(m[0]) < 16 else "\ufffd" if len(m[1]) > 7 or not m[1] else f"&#{m[1]};", text)
    return html.unescape(text)


def attributes(dom: Dom, node: int) -> dict[str, str]:
    return _attributes(dom.source[dom.opens[node] : dom.closes[node]])


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(text)}


def attribute_tokens(tag: str, text: str) -> np.ndarray:
    """Hashed tokens of what an element is called: class, id and role names, whole and in
    words (the first, the last, long ones by their beginning too), names of data attributes,
    and the words of a custom tag."""
    a = _attributes(text) if "=" in text else {}
    names = [n for k in ("class", "id", "itemprop", "aria-label") for n in a.get(k, "").split()]
    names += [tag] if "-" in tag else []
    out = {f"r:{a['role'].lower()}"} if a.get("role") else set()
    for name in names:
        words = [w.lower() for w in WORDS.findall(name)]
        out.add(f"={name.lower()}")
        if words:
            out |= {*words, f"^{words[0]}", f"${words[-1]}", *(f"~{w[:5]}" for w in words if len(w) > 5)}
    for k in a:
        if k.startswith("data-"):
            out |= {f"@{k}", *(f"@{w}" for w in k.split("-")[1:])}
    return np.array(sorted({zlib.crc32(t.encode("utf-8", "replace")) % TOKENS for t in out}), np.int64)


class Survey:
    """Numbers of every element of some pages, most of them sums over what lies under it."""

    def __init__(self, dom: Dom):
        self.dom = dom
        i32 = lambda a: np.frombuffer(a, np.int32) if len(a) else np.zeros(0, np.int32)
        self.parent, self.end, self.depth = (i32(a) for a in (dom.parent, dom.end, dom.depth))
        n, owner = len(dom.tag), i32(dom.owner)
        self.hidden = dom.within(dom.tags_in(SKIP)) > 0
        shown = ~self.hidden & (~dom.tags_in(VOID) | dom.tags_in({INPUT}))
        chars, words, stops = self._texts(i32(dom.text_start), i32(dom.text_end))
        for column in (chars, words, stops):
            column[self.hidden[owner]] = 0
        in_link = dom.within(dom.tags_in({LINK})) > 0
        by = lambda w: np.bincount(owner, w, n).astype(np.int64)
        self.own = by(chars)
        below = lambda x: (c := np.r_[0, np.cumsum(x)])[self.end] - c[:-1]
        self.chars, self.words, self.stops, self.linked = (below(x) for x in (self.own, by(words), by(stops), by(np.where(in_link[owner], chars, 0))))
        self.tags = below(shown & ~dom.tags_in(VOID))
        self.links, self.paragraphs = (below(shown & dom.tags_in({t})) for t in (LINK, PARAGRAPH))
        control = np.zeros(n, np.int64)
        np.add.at(control, self.parent[dom.tags_in(CONTROLS) & ~self.hidden[self.parent]], 1)
        self.inputs = below((shown & dom.tags_in({INPUT})) + control)
        self.page = np.repeat(np.arange(len(dom.roots)), np.diff([*dom.roots, n]))
        root = np.array(dom.roots)[self.page]
        upto = np.r_[0, np.cumsum(chars)]
        start = upto[i32(dom.text_at)]
        self.start, self.total = start - start[root], np.maximum(1, self.chars[root])
        kids = np.flatnonzero(shown & (np.arange(n) != root))
        self.siblings, self.index, self.same = np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)
        order = kids[np.argsort(self.parent[kids], kind="stable")]
        of, first, count = np.unique(self.parent[order], return_index=True, return_counts=True)
        self.siblings[order], self.index[order] = np.repeat(count, count), np.arange(len(order)) - np.repeat(first, count)
        key = self.parent[kids].astype(np.int64) * len(dom.names) + i32(dom.tag)[kids]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        self.same[kids] = count[inverse]
        self.named, self.tokens = self._tokens()
        self.blocks = dom.tags_in(BLOCK)
        self.judged = ~self.hidden & (self.chars > 0) & (self.blocks | self.named)

    def _texts(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Characters that are no white space, words, and stops and commas of each text."""
        code = np.frombuffer(self.dom.source.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = SPACES[np.minimum(code, 0x3000)] & (code <= 0x3000)
        begins = ~space & np.r_[True, space[:-1]] if len(code) else space
        sums = [np.r_[0, np.cumsum(x, dtype=np.int32)] for x in (~space, begins, np.isin(code, [ord(c) for c in ".!?,"]))]
        start, end = np.maximum(start, 0), np.maximum(end, 0)
        chars, words, stops = (c[end] - c[start] for c in sums)
        lead = np.r_[~space, False][start] & ~np.r_[begins, False][start] & (end > start)
        return chars.astype(np.int64), words + lead, stops.astype(np.int64)

    def _tokens(self) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Which elements are called something, and by what tokens."""
        dom, memo, found = self.dom, {}, {}
        custom = np.array(["-" in t for t in dom.names], bool)[np.frombuffer(dom.tag, np.int32)]
        long = np.frombuffer(dom.closes, np.int32) - np.frombuffer(dom.opens, np.int32) > 3
        names = list(dom.names)
        for i in np.flatnonzero(~self.hidden & (custom | long)):
            key = (dom.tag[i], dom.source[dom.opens[i] : dom.closes[i]])
            if key not in memo:
                if len(memo) > 50_000:
                    memo.clear()
                memo[key] = attribute_tokens(names[key[0]], key[1])
            if len(memo[key]):
                found[int(i)] = memo[key]
        named = np.zeros(len(dom.tag), bool)
        named[list(found)] = True
        return named, found

    def weigh(self, weights: np.ndarray) -> None:
        """Takes the weights of tokens: an inline element is judged only if one of its own
        speaks against it, and follows the text it stands in otherwise."""
        self.judged &= self.blocks | (self._weighed(weights)[0] < AGAINST)

    def features(self, weights: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """Columns of ``rows``: density, links, attribute tokens, depth, siblings, place, tag."""
        low, high, total = self._weighed(weights)
        f, p = rows, self.parent[rows]
        c, pc = np.maximum(1, self.chars[f]), np.maximum(1, self.chars[p])
        ratio = lambda a, b: a[f] / np.maximum(1, b[f])
        out = [self.chars[f], ratio(self.chars, self.tags), self.linked[f] / c, self.links[f], self.paragraphs[f], self.inputs[f], self.stops[f] / c, ratio(self.words, self.tags), self.own[f] / c]
        out += [self.chars[f] / self.total[f], self.start[f] / self.total[f], self.depth[f], ratio(self.index, self.siblings), self.siblings[f], ratio(self.same, self.siblings), self.linked[p] / pc, self.chars[f] / pc, self.own[p] / pc]
        out += [low[f], high[f], total[f], total[p], self.above[f] - total[f], self.named[f]]
        kinds = [*({t} for t in TAGS), {"span", "font", "small", "ins", "a"}, {"em", "b", "i", "strong", "cite", "code", "mark", "abbr", "q"}]
        tag = np.frombuffer(self.dom.tag, np.int32)
        here, over = tag[f], tag[p]
        for k, group in enumerate([*kinds, {"nav", "footer", "aside", "form", "header"}, {"article", "main"}]):
            held = np.array([t in group for t in self.dom.names], bool)
            out.append(held[here if k < len(kinds) else over])
        return [np.asarray(x, np.float32) for x in out]

    def _weighed(self, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """Least, greatest and summed weight of each element's tokens; kept for all rows."""
        if getattr(self, "weighed", None) is None:
            low, high, total = (np.zeros(len(self.dom.tag)) for _ in range(3))
            for i, tokens in self.tokens.items():
                w = weights[tokens]
                low[i], high[i], total[i] = w.min(), w.max(), w.sum()
            n = len(total)
            steps = np.r_[total, 0.0]
            np.subtract.at(steps, self.end, total)
            self.weighed, self.above = (low, high, total), np.cumsum(steps)[:n]
        return self.weighed


class Boosted:
    """What was learned: weights of attribute tokens, and boosted trees for a 0/1 target.
    The trees are symmetric: each level asks one question, whatever was answered before."""

    def __init__(self, base: float, weights: np.ndarray, trees: list[tuple]):
        self.base, self.weights, self.trees = base, weights, trees

    def __call__(self, columns: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(columns[0]), self.base)
        for questions, leaf in self.trees:
            at = np.zeros(len(total), np.uint8)
            for feature, cut in questions:
                at += at
                at += columns[feature] > cut
            total += leaf[at]
        return total


def token_weights(parts: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """How much each hashed token speaks for main text: log odds among labelled elements,
    drawn to 0 where few have it."""
    seen = np.ones((2, TOKENS))
    for tokens, label in parts:
        seen[label, tokens] += 1
    sizes = np.array([sum(y == k for _, y in parts) for k in (0, 1)]) + 2.0
    odds = np.log(seen[1] / sizes[1]) - np.log(seen[0] / sizes[0])
    return (np.clip(odds, -4, 4) * (seen.sum(0) > 3)).astype(np.float32)


def boost(columns: list[np.ndarray], y: np.ndarray, trees: int = TREES) -> tuple[float, list[tuple]]:
    """Fits symmetric trees by Newton steps on binned features."""
    cuts = [np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for x in columns]
    cuts = [c if len(np.unique(x)) > 2 else np.array([np.unique(x)[:-1].mean()] if len(np.unique(x)) == 2 else [], np.float32) for c, x in zip(cuts, columns)]
    width = BINS + 1
    bins = np.stack([np.searchsorted(c, x, side="left") for c, x in zip(cuts, columns)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at, questions = np.zeros(len(y), np.int64), []
        for level in range(DEPTH):
            leaves, best = 2**level, (-np.inf, 0, np.float32(np.inf))
            for j, c in enumerate(cuts):
                if len(c):
                    cell = at * width + bins[:, j]
                    lg, lh = (np.bincount(cell, w, leaves * width).reshape(leaves, width).cumsum(1) for w in (g, h))
                    sg, sh = lg[:, -1:], lh[:, -1:]
                    lg, lh = lg[:, : len(c)], lh[:, : len(c)]
                    gain = (lg**2 / (lh + 2) + (sg - lg) ** 2 / (sh - lh + 2)).sum(0)
                    k = int(gain.argmax())
                    if gain[k] > best[0] + 1e-9:
                        best = (gain[k], j, c[k])
            questions.append(best[1:])
            at = 2 * at + (columns[best[1]] > best[2])
        leaf = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 2)
        score = score + leaf[at]
        out.append((questions, leaf))
    return base, out


def decode(survey: Survey, model: Boosted) -> np.ndarray:
    """The most likely labels in which no element under a rejected one is kept.

    An element kept is worth its logit, one rejected nothing; the value of a kept subtree
    is its own logit and the positive values of its children. Top down, a child stays if
    its parent does and its value is positive. Elements that are not judged (inline ones
    that no name speaks against, and what holds no text) follow their parent.
    """
    survey.weigh(model.weights)
    n = len(survey.parent)
    judged = np.flatnonzero(survey.judged)
    logit = np.zeros(n)
    for at in range(0, len(judged), ROWS):
        rows = judged[at : at + ROWS]
        logit[rows] = np.clip(model(survey.features(model.weights, rows)), -8, 8)
    value, parent, is_judged = logit.tolist(), survey.parent.tolist(), survey.judged.tolist()
    above = [0] * n  # the nearest judged element over each, or the root
    for i, up in enumerate(parent):
        above[i] = up if is_judged[up] or up == parent[up] else above[up]
    for i in reversed(judged.tolist()):
        if value[i] > 0 and above[i] != i:
            value[above[i]] += value[i]
    good = ~survey.judged | survey.dom.tags_in({"html", "body"}) | (np.array(value) > 0)
    good[survey.dom.roots] = True
    return survey.dom.within(~good) == 0


def blocks_of(dom: Dom, keep: np.ndarray | None = None) -> list[list[str]]:
    """The text blocks of each page, in order: references decoded, white space made single
    spaces, blocks without text left out."""
    shown = dom.within(dom.tags_in(SKIP)) == 0
    shown = (shown if keep is None else shown & keep).tolist()
    out: list[list[str]] = [[] for _ in dom.roots]
    source, ends = dom.source, [*dom.roots[1:], len(dom.tag)]
    page, run, mark = 0, [], -1

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out[page].append(text)

    for start, end, owner, m in zip(dom.text_start, dom.text_end, dom.owner, dom.mark):
        if m != mark or owner >= ends[page]:
            flush()
            mark = m
            while owner >= ends[page]:
                page += 1
        if shown[owner]:
            run.append(" " if start < 0 else unescape(source[start:end]))
    flush()
    return out


# Words that pages name their parts by, for the layouts to learn from; not a rule of any page.
NAMES = {
    "nav": "nav navbar navigation menu mainmenu breadcrumb breadcrumbs topnav tabs pager pagination skip-links".split(),
    "header": "header masthead topbar toolbar branding banner site-header".split(),
    "footer": "footer foot copyright legal colophon disclaimer imprint".split(),
    "ad": "ad ads adv advert adverts advertisement advertising advertorial adsbygoogle adsense dfp gpt banner leaderboard mpu promo promotion sponsor sponsored sponsoring native-ad taboola outbrain affiliate teads".split(),
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall snackbar toast".split(),
    "form": "search searchform login signup form contact-form register poll".split(),
    "comments": "comments comment-list replies reply respond discussion disqus commentlist".split(),
    "related": "sidebar side rail widget widgets related recommended recommendations more-stories trending popular aside share sharing social follow social-share tags author-bio".split(),
    "content": "article content post entry story main body text prose maincontent articlebody blogpost post-content entry-content story-body article-text copy richtext".split(),
}
TOPICS = "effects rescue history health law science garden theory river city school market energy music winter kitchen travel data animal space ocean bridge method result paper chapter lesson recipe report energy intro summary background analysis discussion example figure note detail step part".split()
# Words that name parts of pages and, with others or inside a sentence, matters too.
DOUBLE = "side search legal social share header footer menu notice form comment reply alert follow hidden copyright subscription sponsor promotion discussion response consent navigation banner network media".split()


class _Layouts:
    """Labelled layouts to learn from: grammars of common page parts whose elements are
    marked as main text or not. Their words mean nothing; the trees see structure and
    names. A page writes its names in one of several manners (plain words, words with
    prefixes and suffixes, block__element, camel case, data attributes)."""

    SUFFIXES = "box wrap wrapper bar slot container list area block section inner left right top bottom unit item panel group 1 2 main".split()
    PREFIXES = "site page c js m top main o widget block module sidebar".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.manner = 0

    def text(self, low: int, high: int) -> str:
        words = ["".join(self.r.choices("abcdefghijklmnoprstuv", k=self.r.randint(2, 9))) for _ in range(self.r.randint(low, high))]
        return " ".join(w + self.r.choice(["", "", "", "", "", ",", "."]) for w in words) + "."

    def invented(self) -> str:
        return "".join(self.r.choices("abcdefghijklmnoprstuvw", k=self.r.randint(2, 9)))

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.text(1, 3)}</a></li>' for i in range(n))

    def word(self, kind: str) -> str:
        """A name of a part, in the page's manner."""
        r, w = self.r, self.r.choice(NAMES[kind])
        if self.manner == 0 or r.random() < 0.3:
            return w
        if self.manner == 1:
            return r.choice([f"{w}-{r.choice(self.SUFFIXES)}", f"{r.choice(self.PREFIXES)}-{w}", f"{w}_{r.choice(self.SUFFIXES)}"])
        if self.manner == 2:
            return r.choice([f"c-{w}", f"{w}__{r.choice(self.SUFFIXES)}", f"l-{w} {w}--{r.choice(self.SUFFIXES)}", f"{r.choice(self.PREFIXES)}__{w}"])
        return r.choice([r.choice(self.PREFIXES) + w.capitalize(), w + r.choice(self.SUFFIXES).capitalize()])

    def name(self, kind: str, often: float = 0.85) -> str:
        r = self.r
        if r.random() > often:
            return ""
        if kind != "content" and r.random() < 0.1:
            w = r.choice([kind, r.choice(NAMES[kind]).split("-")[0]])
            return r.choice([f' data-{w}="1"', f' data-{w}-{r.choice(["slot", "id", "unit"])}="{r.randint(1, 99)}"', f' data-widget-{w}="x"'])
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["", "", "", "x "])}{self.word(kind)}"'

    def matter(self) -> str:
        """A name that says what a piece of main text is about, or nothing at all."""
        r, d = self.r, self.r.choice(DOUBLE + NAMES["content"])
        t = r.choice(TOPICS) if r.random() < 0.4 else self.invented()
        made = r.choice([t, self.invented(), f"{self.invented()}-{self.invented()}-{self.invented()}", f"{r.choice(['is', 'has', 'u', 'text', 'col', 'css'])}-{self.invented()}", f"{d}-{self.invented()}", f"the-{d}-{self.invented()}", t, f"{d}-{t}", f"{d}-and-{t}", f"{t}-{d}", f"{t}-and-{r.choice(TOPICS)}", f"text-{d}", f"{d}-{r.choice(['of', 'in', 'on', 'for'])}-{t}", "s" + str(r.randint(1, 99)), f"wp-block-{t}"])
        return r.choice([f' class="{made}"', f' class="{made}"', f' id="{made}"', f' data-{r.choice(["id", "index", "v", "testid", "line"])}="{r.randint(1, 999)}"', f' data-testid="{t}"'])

    def inline(self, low: int, high: int, kind: str) -> str:
        """An inline or custom element that is named for the advert or notice it holds."""
        r = self.r
        if r.random() < 0.3:
            w = r.choice(NAMES[kind])
            return (lambda tag: f"<{tag}>{self.text(low, high)}</{tag}>")(r.choice([f"x-{w}", f"{w}-box", f"site-{w}"]))
        tag = r.choice(["span", "span", "a", "font", "ins", "ins", "small"])
        return f"<{tag}{self.name(kind, 1)}>{self.text(low, high)}</{tag}>"

    def mention(self) -> str:
        """An inline element of a sentence: emphasis, a term, a link, whatever it is called."""
        r = self.r
        if r.random() < 0.25:
            return f'<a{r.choice(["", self.matter(), self.matter()])} href="/x">{self.text(1, 4)}</a>'
        tag = r.choice(["em", "em", "i", "b", "strong", "cite", "code", "mark", "abbr", "q", "span", "span", "span", "sup"])
        own = f' {r.choice(["class", "id"])}="{r.choice(DOUBLE)}"' if tag not in ("span", "a") and r.random() < 0.5 else self.matter()
        return f"<{tag}{own}>{self.text(1, r.choice([2, 4, 12]))}</{tag}>"

    def other(self, kind: str) -> str:
        r, t, n = self.r, self.text, self.name
        if kind in ("ad", "notice") and r.random() < 0.3:
            return self.inline(2, 40, kind)
        if kind == "nav":
            return r.choice([f"<nav{n(kind)}><ul>{self.links(r.randint(2, 9))}</ul></nav>", f"<div{n(kind)}><ul>{self.links(r.randint(2, 9))}</ul></div>", f"<ul{n(kind)}>{self.links(r.randint(2, 9))}</ul>"])
        if kind == "header":
            return r.choice([f"<header{n(kind)}><h1>{t(1, 4)}</h1><p>{t(2, 6)}</p></header>", f"<div{n(kind, 1)}>{t(1, 8)}</div>", f'<div{n(kind, 1)}><a href="/">{t(1, 3)}</a></div>'])
        if kind == "footer":
            return r.choice([f"<footer>&copy; {t(1, 40)}</footer>", f"<footer>{t(1, 30)}</footer>", f"<footer{n(kind)}><p>{t(2, 14)}</p><ul>{self.links(3)}</ul></footer>", f"<div{n(kind, 1)}><p>{t(2, 20)}</p></div>", f"<div{n(kind, 1)}>{t(2, 12)}</div>"])
        if kind == "ad":
            return r.choice([f"<div{n(kind, 1)}>{t(3, 60)}</div>", f"<div{n(kind, 1)}><p>{t(3, 60)}</p></div>", f'<aside{n(kind, 1)}><a href="/">{t(2, 20)}</a></aside>', f"<section{n(kind, 1)}><p>{t(3, 40)}</p></section>", f"<p{n(kind, 1)}>{t(3, 40)}</p>"])
        if kind == "notice":
            return r.choice([f"<div{n(kind, 1)}><p>{t(6, 60)}</p><button>{t(1, 2)}</button></div>", f"<div{n(kind, 1)}>{t(6, 60)}</div>", f"<section{n(kind, 1)}><p>{t(6, 50)}</p></section>", f"<p{n(kind, 1)}>{t(6, 40)}</p>", f"<div{n(kind, 1)}>{t(4, 30)} <button>{t(1, 2)}</button></div>"])
        if kind == "form":
            return r.choice([f'<form action="/s"{n(kind)}><label>{t(1, 6)}</label><input name="q"><button>{t(1, 2)}</button></form>', f'<form><p>{t(3, 30)}</p><input type="text"><textarea></textarea></form>'])
        if kind == "comments":
            inner = "".join(f'<{e} class="{r.choice(["comment", "reply", "", "comment-item"])}"><p>{t(4, 60)}</p></{e}>' for e in [r.choice(["div", "article", "li"])] for _ in range(r.randint(1, 5)))
            tag = r.choice(["section", "div", "div", "ol"])
            return f"<{tag}{n(kind, 1)}>{f'<h2>{t(1, 2)}</h2>' if tag == 'section' else ''}{inner}</{tag}>"
        inner = r.choice([f"<p>{t(6, 60)}</p>", f"<h3>{t(1, 4)}</h3><ul>{self.links(4)}</ul>", f"<div>{t(4, 40)}</div>", f"<ul>{self.links(4)}</ul>"]) * r.randint(1, 3)
        return r.choice([f"<aside{n(kind)}>{inner}</aside>", f"<div{n(kind, 1)}>{inner}</div>", f"<section{n(kind, 1)}>{inner}</section>", f"<td{n(kind, 1)}>{inner}</td>"])

    def content(self) -> str:
        r, t = self.r, self.text
        kinds = r.choices(["p", "p", "p", "p", "p", "p", "h2", "ul", "quote", "pre", "table", "bold", "named", "named", "named", "named", "part", "part", "part"], k=r.choice([0, 0, 1, 1, 2, 3, 5, 9, 20]))
        own = lambda: self.matter() if r.random() < 0.3 else ""
        make = {
            "p": lambda: f"<p{own()}>{t(1, 90)}</p>", "h2": lambda: f"<h2{own()}>{t(1, 8)}</h2>", "ul": lambda: f"<ul{own()}>" + "".join(f"<li>{t(2, 20)}</li>" for _ in range(4)) + "</ul>",
            "quote": lambda: f"<blockquote{own()}><p>{t(5, 40)}</p></blockquote>", "pre": lambda: f"<pre{own()}>{t(5, 30)}</pre>", "table": lambda: f"<table{own()}><tr><th>{t(1, 3)}</th><td>{t(1, 9)}</td></tr></table>",
            "bold": lambda: f"<p><b>{t(3, 60)}<br>", "named": lambda: f"<p>{t(1, 30)} {self.mention()} {t(1, 30)}</p>",
            "part": lambda: (lambda tag: f"<{tag}{self.matter()}>{f'<h2>{t(1, 5)}</h2>' if r.random() < 0.4 else ''}" + "".join(f"<p>{t(1, r.choice([3, 10, 60]))}</p>" for _ in range(r.randint(1, 4))) + f"</{tag}>")(r.choice(["section", "div", "div"])),
        }
        head = f"<h1>{t(1, 12)}</h1>" if r.random() < 0.8 else ""
        if head and r.random() < 0.15:
            head = f"<header>{head}</header>"
        parts = [make[k]() for k in kinds] or [r.choice([f"<p>{t(1, 60)}</p>", f"<p>{t(1, 4)}</p>", make["part"](), make["part"](), make["part"]()])]
        for k in ("ad", "notice", "form", "comments", "related"):
            if r.random() < 0.14:
                parts.insert(r.randint(0, len(parts)), f"<!--x-->{self.other(k)}<!--y-->")
        if r.random() < 0.3:  # an advert or a notice in the middle of a sentence
            parts.insert(r.randint(0, len(parts)), f"<p>{t(3, 30)} <!--x-->{self.inline(2, 20, r.choice(['ad', 'ad', 'notice']))}<!--y--> {t(3, 30)}</p>")
        return head + "".join(parts)

    def page(self) -> str:
        r = self.r
        self.manner = r.choice([0, 0, 1, 1, 2, 3])
        open_, close = r.choice([("<article>", "</article>")] * 6 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<section class="post">', "</section>"), (f"<div{self.name('content', 1)}>", "</div>"), (f"<div{self.name('content', 1)}>", "</div>"), ('<main><article class="story">', "</article></main>"), (f"<table><tr><td{self.name('content', 1)}>", "</td></tr></table>")])
        body = [f"<!--a-->{open_}{self.content()}{close}<!--b-->"]
        for kind, share in (("footer", 0.8), ("comments", 0.3), ("related", 0.35), ("ad", 0.3), ("notice", 0.3), ("form", 0.2)):
            if r.random() < share:
                body.append(f"<!--x-->{self.other(kind)}<!--y-->")
        for kind, share in (("related", 0.2), ("ad", 0.6), ("notice", 0.25), ("form", 0.2), ("nav", 0.8), ("header", 0.4)):
            if r.random() < share:
                body.insert(0, f"<!--x-->{self.other(kind)}<!--y-->")
        inner = "".join(body)
        if r.random() < 0.3:
            inner = f'<div{r.choice(["", " class=wrapper", " id=container", " class=page", " class=site-wrap"])}>{inner}</div>'
        return f"<html><head><title>{self.text(1, 5)}</title></head><body>{inner}</body></html>"


MARK = re.compile(r"<!--([abxy])-->")


def labelled(page: str) -> tuple[str, list[int]]:
    """The page without marks, and for each of its elements whether it is main text (2: not
    said), in the order of their start tags."""
    state, depth, out, labels, at = 0, 0, [], [], 0
    for m in TOKEN.finditer(page):
        out.append(page[at : m.end()] if not MARK.fullmatch(m[0]) else page[at : m.start()])
        at = m.end()
        if k := MARK.fullmatch(m[0]):
            state, depth = (1 if k[1] == "a" else 0 if k[1] == "b" else state), depth + {"x": 1, "y": -1}.get(k[1], 0)
        elif m[0][1] not in "/!?":
            labels.append(2 if not state and not depth else int(state and not depth))
    out.append(page[at:])
    return "".join(out), labels


def labelled_survey(layouts: list[str]) -> tuple[Survey, np.ndarray]:
    """The survey of labelled layouts, and the label of each element."""
    pairs = [labelled(x) for x in layouts]
    return Survey(parse([p for p, _ in pairs])), np.concatenate([[2, *labels] for _, labels in pairs])


@functools.lru_cache(maxsize=4)
def fit(pages: int = TRAIN_PAGES, seed: int = 11) -> Boosted:
    """Token weights and trees fitted on ``pages`` labelled layouts (a fixed, bounded
    number), once a process. The trees learn from other pages than the weights, so they
    know how far to trust them."""
    make = _Layouts(seed)
    made = [make.page() for _ in range(pages)]
    survey, labels = labelled_survey(made[: pages * 5 // 8])
    weights = token_weights([(t, int(labels[i])) for i, t in survey.tokens.items() if labels[i] < 2 and survey.judged[i]])
    survey, labels = labelled_survey(made[pages * 5 // 8 :])
    survey.weigh(weights)
    rows = np.flatnonzero(survey.judged & (labels < 2))
    columns = survey.features(weights, rows)
    base, trees = boost(columns, labels[rows].astype(np.float64))
    return Boosted(base, weights, trees)


def main_text(page: str | None, model: Boosted) -> str:
    return texts_of([page], model)[0]


def texts_of(pages: list[str | None], model: Boosted) -> list[str]:
    dom = parse([p or "" for p in pages])
    return ["\n".join(t) for t in blocks_of(dom, decode(Survey(dom), model))]


def extract(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", model: Boosted | None = None) -> DataFrame:
    """``id_cols``, ``text`` and ``n_chars`` of every page, one row a row, no shuffle.

    Blocks of main text are joined by newlines. Null and empty pages, and pages without
    main text, give an empty text. Repeated rows stay repeated; an empty table gives an
    empty result; other columns are not read. Pages are read together up to half a million
    characters, a longer one by itself, which bounds what a task holds.
    """
    trees = model or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(np.nan_to_num(pc.utf8_length(b.column(len(id_cols))).to_numpy(zero_copy_only=False).astype(float)))
            cuts = np.flatnonzero(np.diff(size // BATCH_CHARS, prepend=0)) if b.num_rows else []
            for at, end in zip([0, *cuts], [*cuts, b.num_rows]):
                if at < end:
                    part = b.slice(at, end - at)
                    texts = texts_of(part.column(len(id_cols)).to_pylist(), trees)
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(id_cols)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*id_cols, "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in id_cols)
    return pages.select(*id_cols, F.col(html_col).alias("__html")).mapInArrow(run, f"{kinds}, text string, n_chars long")
