"""Block elements of a web page, in page order, with what describes them.

Elements that make a block are nodes, and so are elements with names of the page's
own and spans with attributes; other inline elements only add to the counts of
the node around them. Scripts, styles and other elements without running text,
comments and declarations are skipped. Open paragraphs and list items end where
the next block begins, a page may end anywhere.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import takewhile

import numpy as np

_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup label legend li main menu nav ol p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
_SKIPPED = frozenset("script style noscript template textarea title iframe svg head audio video canvas option datalist".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
_BREAKS = frozenset(("br", "hr", "wbr"))
_INLINE = "span"
_HEADINGS = frozenset(("h2", "h3", "h4", "h5", "h6"))
# Words of headings that say what stands below, in the languages of the pages.
_SAYING = frozenset(
    "comment comments response responses reply replies discussion kommentar kommentare antworten commentaire commentaires "
    "réponses comentario comentarios respuestas".split()
)
_SAID = re.compile(r"\w+")
# What a start tag ends when it is open: up to, not through, the elements that hold it.
_ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|aria-label|data-main)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Page:
    """Nodes of one page as parallel lists; node 0 is the root. Text pieces name their node."""

    def __init__(self, html: str, marked: bool = False):
        self._marked = marked
        self._unclosed: set[str] = set()
        self._open_tags: dict[str, int] = {}
        self._plain_spans: dict[int, int] = {}  # open spans that are no nodes, by the node around them
        self.tags: list[str] = ["root"]
        self.attrs: list[tuple[str, ...]] = [()]
        self.mark: list[int] = [-1]  # 1 or 0 where a page made for training says so
        self.parent: list[int] = [0]
        self.depth: list[int] = [0]
        self.end: list[int] = [1]  # one after the last node of the subtree
        self.pieces: list[tuple[int, str]] = []
        self.counts: list[list[int]] = [[0, 0, 0, 0, 0]]  # own characters, in links, punctuation, inline tags, form fields
        self._read(html)

    def _read(self, html: str) -> None:
        stack = [0]
        links = at = 0
        size = len(html)
        while at < size:
            m = _TAG.search(html, at)
            if m is None:
                self._text(stack[-1], html[at:], links)
                break
            if m.start() > at:
                self._text(stack[-1], html[at : m.start()], links)
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            block = name in _BLOCKS or "-" in name
            if m["end"]:
                if name == "a":
                    links = 0
                elif block:
                    if name in _HEADINGS:
                        self._say(stack)
                    self._close(stack, name)
                    self.pieces.append((stack[-1], " "))
                    links = 0
                elif name == _INLINE and self._plain_spans.get(stack[-1], 0):
                    self._plain_spans[stack[-1]] -= 1
                elif name == _INLINE and self.tags[stack[-1]] == _INLINE:
                    self._pop(stack)
            elif name in _SKIPPED:
                at = self._skip(html, at, name, m["attrs"])
            elif block:
                self._open(stack, name, m["attrs"])
                links = 0
            elif name == _INLINE and "=" in m["attrs"]:
                self._node(stack, name, m["attrs"])
            elif name in _BREAKS:
                self.pieces.append((stack[-1], " "))
            else:
                links = 1 if name == "a" else links
                if name == _INLINE:  # its end tag ends no node
                    self._plain_spans[stack[-1]] = self._plain_spans.get(stack[-1], 0) + 1
                self.counts[stack[-1]][4 if name == "input" else 3] += 1
        while len(stack) > 1:
            self._pop(stack)
        self.end[0] = len(self.tags)

    def _skip(self, html: str, at: int, name: str, attrs: str) -> int:
        """Where the page goes on after an element that holds no running text."""
        if attrs.rstrip().endswith("/") and name not in _RAW:
            return at
        if name not in self._unclosed:  # a search that found no end need not be made again further on
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            if close:
                return close.end()
            self._unclosed.add(name)
        if name == "head":
            body = re.compile(r"<body(?=[\s/>])", re.I).search(html, at)
            return body.start() if body else at
        return len(html) if name in _RAW else at

    def _text(self, node: int, raw: str, links: int) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.pieces.append((node, text))
        n = len(text.strip())
        if n:
            own = self.counts[node]
            own[0] += n
            own[1] += n * links
            own[2] += len(_PUNCTUATION.findall(text))

    def _open(self, stack: list[int], name: str, attrs: str) -> None:
        # A block ends an open paragraph or heading-less run; list items and cells end their like.
        if self._open_tags.get("p") and name not in ("label", "button", "select"):
            place = len(stack) - 1
            while self.tags[stack[place]] == _INLINE:
                place -= 1
            if self.tags[stack[place]] == "p":
                while len(stack) > place:
                    self._pop(stack)
        if name in _ENDS:
            ended, within = _ENDS[name]
            for place in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[place]]
                if tag in within:
                    break
                if tag in ended:
                    while len(stack) > place:
                        self._pop(stack)
                    break
        self.pieces.append((stack[-1], " "))
        self._node(stack, name, attrs)
        self.pieces.append((stack[-1], " "))

    def _node(self, stack: list[int], name: str, attrs: str) -> None:
        node, parent = len(self.tags), stack[-1]
        found, mark = name.split("-") if "-" in name else [], -1
        if "=" in attrs:
            for key, value in _ATTR.findall(attrs):
                if key.lower() != "data-main":
                    found += [t.lower() for t in _TOKEN.findall(value)]
                elif self._marked:
                    mark = int(value.strip("\"'"))
        tokens = tuple(dict.fromkeys(found))
        self.tags.append(name)
        self.attrs.append(tokens)
        self.mark.append(mark if mark >= 0 else self.mark[parent])
        self.parent.append(parent)
        self.depth.append(len(stack))
        self.end.append(node + 1)
        self.counts.append([0, 0, 0, 0, 1 if name in ("button", "select") else 0])
        self._open_tags[name] = self._open_tags.get(name, 0) + 1
        stack.append(node)

    def _say(self, stack: list[int]) -> None:
        """Words of a heading that ends here and say what its block is are tokens of that block."""
        node = stack[-1]
        if self.tags[node] not in _HEADINGS:
            return
        text = "".join(t for _, t in takewhile(lambda p: p[0] == node, reversed(self.pieces)))
        if len(text) <= 80:
            words = [f"says {w}" for w in _SAID.findall(text.lower()) if w in _SAYING]
            above = self.parent[node]
            self.attrs[above] = tuple(dict.fromkeys([*self.attrs[above], *words]))

    def _pop(self, stack: list[int]) -> None:
        node = stack.pop()
        self.end[node] = len(self.tags)
        self._open_tags[self.tags[node]] -= 1

    def _close(self, stack: list[int], name: str) -> None:
        if not self._open_tags.get(name):
            return
        for place in range(len(stack) - 1, 0, -1):
            if self.tags[stack[place]] == name:
                while len(stack) > place:
                    self._pop(stack)
                return

    def text(self, kept: list[bool]) -> str:
        """Text of the kept nodes: one space for white space and between blocks."""
        return " ".join("".join([t if kept[node] else " " for node, t in self.pieces]).split())


class Vocabulary:
    """Log-odds of tags and attribute tokens, learned from marked pages."""

    def __init__(self, tags: dict[str, float], tokens: dict[str, float]):
        self._tags, self._tokens = tags, tokens
        self._seen: dict[tuple[str, ...], tuple[float, float]] = {(): (0.0, 0.0)}

    @classmethod
    def learn(cls, pages: list[Page]) -> Vocabulary:
        counts: tuple[dict, dict] = ({}, {})
        for page in pages:
            for node in range(1, len(page.tags)):
                for table, keys in zip(counts, ((page.tags[node],), page.attrs[node])):
                    for key in keys:
                        table.setdefault(key, [1, 1])[page.mark[node] == 1] += 1
        odds = [{k: float(np.log(yes / no)) for k, (no, yes) in t.items()} for t in counts]
        return cls(*odds)

    def tag(self, name: str) -> float:
        return self._tags.get(name, 0.0)

    def attrs(self, tokens: tuple[str, ...]) -> tuple[float, float]:
        """Least and greatest log-odds of the tokens, zero included."""
        found = self._seen.get(tokens)
        if found is None:
            odds = [self._tokens.get(t, 0.0) for t in tokens]
            found = min(0.0, *odds) if odds else 0.0, max(0.0, *odds) if odds else 0.0
            if len(self._seen) < 50_000:
                self._seen[tokens] = found
        return found


def features(pages: list[Page], vocabulary: Vocabulary) -> np.ndarray:
    """One row for each node of all pages, in order."""
    blocks = [_page_features(p, vocabulary) for p in pages]
    return np.concatenate(blocks) if blocks else np.zeros((0, 27))


def _page_features(page: Page, vocabulary: Vocabulary) -> np.ndarray:
    n = len(page.tags)
    parent, end, depth = np.array(page.parent), np.array(page.end), np.array(page.depth, float)
    tag = np.array([vocabulary.tag(t) for t in page.tags])
    attr = np.array([vocabulary.attrs(a) for a in page.attrs])
    above = np.zeros((n, 4))  # least and greatest tag and attribute odds of the ancestors
    for node in range(1, n):
        p = page.parent[node]
        a, t, (low, high) = above[p], tag[p], attr[p]
        above[node] = (min(a[0], t), max(a[1], t), min(a[2], low), max(a[3], high))
    own = np.array(page.counts, float)
    before = np.concatenate([np.zeros((1, 5)), own.cumsum(0)])
    subtree = before[end] - before[np.arange(n)]
    below = end - np.arange(n) - 1.0
    children = np.bincount(parent[1:], minlength=n).astype(float)
    index = np.zeros(n)
    previous, following = np.full(n, -1), np.full(n, -1)
    last: dict[int, int] = {}
    alike: dict[tuple[int, str], int] = {}
    for node in range(1, n):
        p = page.parent[node]
        if p in last:
            previous[node], following[last[p]] = last[p], node
            index[node] = index[last[p]] + 1
        last[p] = node
        key = (p, page.tags[node])
        alike[key] = alike.get(key, 0) + 1
    same = np.array([alike.get((p, t), 1) for p, t in zip(page.parent, page.tags)], float)
    chars = subtree[:, 0]
    total = max(chars[0], 1.0)
    padded = np.append(chars, 0.0)  # place -1: no such sibling
    siblings = np.maximum(children[parent], 1)
    share = subtree[:, 1:] / np.maximum(chars, 1.0)[:, None]
    return np.column_stack([
        tag, attr, above, depth, children, below, np.log1p(chars), np.log1p(own[:, 0]), chars / total, before[:n, 0] / total,
        np.log1p(chars / (1.0 + below + subtree[:, 3])), share[:, 0], share[:, 1], share[:, 2], subtree[:, 4],
        siblings, index / siblings, same, np.log1p(padded[previous]), np.log1p(padded[following]),
        np.log1p(chars[parent]), share[parent, 0], np.log1p(below[parent]),
    ])


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Nodes to keep, so that the odds of all kept nodes are greatest and every kept node's parent is kept."""
    n = len(page.tags)
    gain = odds.tolist()
    gain[0] = 0.0
    for node in range(n - 1, 0, -1):
        if gain[node] > 0:
            gain[page.parent[node]] += gain[node]
    kept = [True] * n
    for node in range(1, n):
        kept[node] = kept[page.parent[node]] and gain[node] > 0
    return kept
