"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into a flat list of text blocks at block-level tags.  Each block has
its words and link density, those of the blocks before and after it, whether it
is a heading or a list entry, and a hint from the elements round it (a menu, a
notice, a comment list; an article).  A tree grown on the small table below says
which blocks belong to the article.

Odd input: a null page is an empty one and gives an empty text.  Unclosed and
misplaced tags, comments and scripts that never end, and plain text without tags
are all read in one pass.  Other columns of the input are ignored, repeated rows
stay, an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import per_batch, texts_of

#: Elements whose content is no text of the page, up to their end tag whatever stands between.
_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript", "template", "svg", "math"))
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no part of an article; a page header only where it stands outside of one.
_BOILER = frozenset("nav footer aside form menu dialog button select option fieldset head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words in a class, id or role that name something beside the article.
_STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion comment comments "
    "commentlist disqus reply replies respond cookie cookies consent gdpr notice notices notification alert newsletter "
    "subscribe subscription signup share sharing social related recommended recommendations trending popular sidebar "
    "sidebars popup modal overlay paywall login breadcrumb breadcrumbs pagination pager widget widgets skip toolbar".split()
)
_WEAK = frozenset("nav navbar navigation menu menus header masthead footer foot banner topbar links copyright search tags meta".split())
_CONTENT = frozenset("article content main post entry story body text".split())
_NEGATED = frozenset("with has no without".split())

#: Blocks marked by hand, one a line: words and link density of the block before, of the block itself and of the block
#: after it, kind (0 paragraph, 1 heading, 2 list entry), hint (-1 beside the article, 0 none, 1 in it), and 1 if the
#: block belongs to the main text.  Before the first and after the last block stand 0 words.
MARKED_BLOCKS = """
0 0 1 1 1 1 2 -1 0
1 1 1 1 1 1 2 -1 0
1 1 2 1 12 0 2 -1 0
1 1 12 0 9 0 0 -1 0
1 1 30 0 9 0 0 -1 0
40 0 14 0 0 0 0 -1 0
40 0 3 0 0 0 0 -1 0
3 0 60 0 25 0 0 -1 0
60 0 25 0.1 8 0 0 -1 0
8 0.5 6 0.2 4 0 1 -1 0
90 0 120 0 3 1 0 -1 0
4 1 45 0.05 4 1 2 -1 0
0 0 45 0 80 0 0 -1 0
12 0 9 0 50 0 1 1 1
12 0 1 0 50 0 1 1 1
9 0 50 0 80 0 0 1 1
50 0 1 0 40 0 0 1 1
50 0 2 0 1 0 0 1 1
2 0 1 0 2 0 0 1 1
80 0 30 0 0 0 0 1 1
80 0 3 0 0 0 0 1 1
80 0 3 0 12 0.2 0 1 1
30 0 15 0.3 40 0 0 1 1
30 0 12 0.6 40 0 0 1 1
30 0 25 0.8 40 0 0 1 1
40 0 6 0 7 0 2 1 1
6 0 7 0.1 5 0 2 1 1
20 0 8 1 30 0 0 1 1
60 0 4 1 4 1 2 1 0
4 1 5 1 4 1 2 1 0
5 1 6 1 0 0 2 1 0
60 0 3 1 3 1 0 1 0
3 1 2 1 2 1 0 1 0
4 1 3 1 50 0 0 1 0
0 0 1 1 1 1 2 0 0
1 1 1 1 2 1 2 0 0
2 1 1 1 60 0 2 0 0
2 1 2 1 3 1 0 0 0
3 1 4 0.9 3 1 0 0 0
5 1 20 0.9 5 1 0 0 0
40 0 12 1 10 1 2 0 0
1 1 8 0 60 0 1 0 1
0 0 8 0 60 0 1 0 1
4 1 5 0 4 1 1 0 0
3 1 4 0 6 1 0 0 0
3 1 9 0 2 1 0 0 0
8 0 60 0 45 0 0 0 1
60 0 45 0.1 70 0 0 0 1
45 0 18 0 52 0 0 0 1
45 0 4 0 52 0 0 0 1
45 0 1 0 52 0 0 0 1
45 0 1 0 20 0 0 0 1
45 0 16 0.3 52 0 0 0 1
45 0 9 0 40 0 1 0 1
60 0 70 0 5 0 0 0 1
60 0 22 0 5 1 0 0 1
22 0 5 0 0 0 0 0 0
22 0 6 0.5 0 0 0 0 0
5 1 7 0 3 1 0 0 0
0 0 30 0 0 0 0 0 1
0 0 4 0 0 0 0 0 1
0 0 1 0 0 0 0 0 1
0 0 3 0 0 0 1 0 1
0 0 12 0 14 0 0 0 1
12 0 14 0 0 0 0 0 1
30 0 8 0 9 0 2 0 1
8 0 9 0 25 0 2 0 1
1 1 9 0 40 0 1 1 1
1 1 5 0 12 0 1 1 1
2 1 3 0 2 0 0 1 1
4 1 20 0 15 0 0 1 1
4 1 60 0 90 0 0 1 1
1 0.5 12 0 1 0 0 1 1
6 0.3 8 0 4 0 0 1 1
3 1 70 0 3 0 0 1 1
1 1 2 0 0 0 0 1 1
2 1 80 0 70 0 0 -1 0
90 0 70 0 80 0 0 -1 0
1 0 1 0 1 0 0 -1 0
5 0.4 40 0.1 6 0.5 0 -1 0
70 0 9 0 60 0 1 -1 0
60 0 80 0 90 0 2 -1 0
3 0.7 4 0 20 0 1 0 1
4 1 3 0 30 0 1 0 1
5 1 5 0 15 0 1 0 1
2 1 40 0 35 0 0 0 1
3 0.8 25 0 60 0 0 0 1
1 1 90 0 3 1 0 0 1
2 1 2 0 0 0 0 0 0
3 1 5 0 0 0 0 0 0
2 1 4 0 3 0 0 0 0
"""
MARKED = np.array([[float(x) for x in line.split()] for line in MARKED_BLOCKS.strip().splitlines()])


def grow_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 8):
    """A tree of (feature, limit, below, above) that splits for the least Gini impurity; a leaf is 0 or 1."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = (np.inf, -1, 0.0)
    for feature in range(rows.shape[1]):
        seen = np.unique(rows[:, feature])
        for limit in (seen[1:] + seen[:-1]) / 2:
            below = rows[:, feature] < limit
            cost = sum(m.sum() * labels[m].mean() * (1 - labels[m].mean()) for m in (below, ~below))
            best = min(best, (cost, feature, float(limit)))
    if best[1] < 0:
        return int(share >= 0.5)
    below = rows[:, best[1]] < best[2]
    return best[1], best[2], grow_tree(rows[below], labels[below], depth - 1), grow_tree(rows[~below], labels[~below], depth - 1)


def classify(tree, rows: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    out = np.zeros(len(rows), np.int8)
    open_ = [(tree, np.arange(len(rows)))]
    while open_:
        node, at = open_.pop()
        if isinstance(node, int):
            out[at] = node
        elif len(at):
            below = rows[at, node[0]] < node[1]
            open_ += [(node[2], at[below]), (node[3], at[~below])]
    return out


def _hint(name: str, attributes: str, around: int) -> int:
    """What an element says about its text, given what is said round it."""
    if name in _BOILER or _HIDDEN.search(attributes):
        return -1
    hint = 1 if name in ("article", "main") else around
    if name == "header" and around != 1:
        hint = -1
    if attributes and name not in ("html", "body"):
        for kind, *values in _ATTRIBUTE.findall(attributes):
            words = set(_WORD.findall("".join(values).lower()))
            if kind.lower() == "role":
                hint = -1 if words & _ROLES else 1 if "main" in words and around == 0 else hint
            elif words & _NEGATED:
                continue
            elif words & _STRONG or words & _WEAK and not words & _CONTENT:
                hint = -1
            elif words & _CONTENT and hint == 0:
                hint = 1
    return -1 if around == -1 and name not in ("main",) else hint


class _Tags:
    """Where tags end; a quote hides what ends a tag, and one that is never closed hides nothing.

    Each quote is looked at once for the whole page, whatever tags it may belong to.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.known: dict[int, int] = {}

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``, or -1."""
        passed = []
        while at not in self.known:
            passed.append(at)
            hit = _QUOTE_OR_END.search(self.page, at) if at <= self.last else None
            if hit is None:
                found = -1
                break
            if hit[0] == ">":
                found = hit.start()
                break
            closed = self.page.find(hit[0], hit.end())
            if closed < 0:
                found = -1
                break
            at = closed + 1
        else:
            found = self.known[at]
        self.known.update(dict.fromkeys(passed, found))
        return found

    def plain_end(self, at: int) -> int:
        return self.page.find(">", at) if at <= self.last else -1


def tokens(page: str):
    """(begin, end, name, closing, attributes) of every tag; comments, declarations and skipped elements have no name.

    A skipped element (a script, say) is one token up to its end tag, with ``closing`` set.
    """
    tags, at, low = _Tags(page), page.find("<"), None
    while at >= 0:
        end, told = -1, None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end, told = (end + 3 if end >= 0 else len(page)), ("", False, "")
        elif m := _NAME.match(page, at):
            name, found = m[2].lower(), tags.end(m.end())
            if found >= 0 and not m[1] and name in _RAW:
                low = page.lower() if low is None else low
                close = low.find("</" + name, found + 1)
                close = tags.plain_end(close) if close >= 0 else -1
                end, told = (close + 1 if close >= 0 else len(page)), ("", True, "")
            else:
                whole = found >= 0
                found = found if whole else tags.plain_end(m.end())
                if found >= 0:
                    # An end tag with a broken quote names nothing.
                    end, told = found + 1, (name, bool(m[1]), page[m.end() : found]) if whole or not m[1] else ("", False, "")
        elif page[at + 1 : at + 2] in ("/", "!", "?"):
            end = tags.plain_end(at) + 1
            told = ("", False, "") if end > 0 else None
        if told is not None:
            yield at, end, *told
        at = page.find("<", end if told is not None else at + 1)


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words in links, kind, hint) of every text block, in page order."""
    found: list[tuple[str, int, int, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    state = {"linked": 0, "kind": 0, "hint": 0, "begun": False}

    def end_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append((text, state["linked"], state["kind"], state["hint"]))
        parts.clear()
        state.update(linked=0, begun=False)

    def add(text: str) -> None:
        if not text:
            return
        if not state["begun"] and not text.isspace():
            state.update(
                begun=True, hint=stack[-1][1] if stack else 0,
                kind=1 if any(map(opened.get, _HEADING)) else 2 if opened.get("li") else 0,
            )
        parts.append(text)
        if opened.get("a"):
            state["linked"] += len(text.split())

    def close(name: str) -> None:
        while stack:
            top = stack.pop()[0]
            opened[top] -= 1
            if top == name:
                break

    at = 0
    for begin, end, name, ends, attributes in tokens(page):
        add(page[at:begin])
        at = end
        if not name:
            if ends:
                end_block()
            continue
        around = stack[-1][1] if stack else 0
        if name in _INLINE or name == "br":
            if name == "br":
                parts.append(" ")
            hint = around if ends or not attributes else _hint(name, attributes, around)
            if hint != around:
                end_block()
        else:
            end_block()
            hint = around
        if ends:
            if opened.get(name):
                # An inline element that stands for an advert or the like ends its own block.
                if name in _INLINE and around != (stack[-2][1] if len(stack) > 1 else 0):
                    end_block()
                close(name)
        elif name not in _VOID:
            if name not in _INLINE:
                # A block-level tag ends an open paragraph; entries of lists and tables end each other.
                if opened.get("p"):
                    close("p")
                for same in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    if name == same and stack and stack[-1][0] == same:
                        close(same)
                hint = _hint(name, attributes, stack[-1][1] if stack else 0)
            elif name == "a" and opened.get("a"):
                close("a")
            stack.append((name, hint))
            opened[name] = opened.get(name, 0) + 1
    rest = page[at:]
    # A tag that the page breaks off in is no text.
    cut = re.search(r"<[/!a-zA-Z][^<>]*\Z", rest)
    add(rest[: cut.start()] if cut else rest)
    end_block()
    return found


def block_features(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    words = np.array([0, *(len(text.split()) for text, *_ in found), 0], float)
    linked = np.array([0, *(n for _, n, *_ in found), 0], float)
    density = np.minimum(linked / np.maximum(words, 1), 1.0)
    kind, hint = (np.array([b[i] for b in found], float) for i in (2, 3))
    return np.stack([words[:-2], density[:-2], words[1:-1], density[1:-1], words[2:], density[2:], kind, hint], axis=1)


def main_text(page: str, tree) -> tuple[str, int]:
    """The article of a page, its blocks joined by one space, and how many blocks the page has."""
    found = blocks(page)
    if not found:
        return "", 0
    keep = classify(tree, block_features(found))
    return " ".join(b[0] for b, k in zip(found, keep) if k), len(found)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_blocks) for every page."""
    tree = grow_tree(MARKED[:, :-1], MARKED[:, -1])

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [main_text(p, tree) for p in texts_of(batch, "html")]
            return pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in made], pa.string()),
                 pa.array([n for _, n in made], pa.int32())],
                ["page_id", "url", "text", "n_blocks"],
            )

        return step

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return per_batch(picked, build, "page_id long, url string, text string, n_blocks int")
