"""Main text of web pages by boosted trees over the nodes of the page.

Every block element is described by its tag and attribute tokens, those of its
ancestors, depth, the size and density of its subtree, its links, punctuation
and form fields, and its siblings (``dom``). Boosted trees (``boosted``) give
the log-odds that it belongs to the article. Decoding picks the set of nodes
with the greatest sum of log-odds among the sets in which a kept node's parent
is kept: nothing survives inside a dropped menu, and a doubtful wrapper stays
when what it holds outweighs it.

There are no labelled pages, so the trees learn from pages rebuilt for the
purpose: paragraphs and words of at most ``SAMPLE_ROWS`` whole pages, picked by a
hash, are put into article and side parts of randomly drawn layouts, which say what each node is. The draw is seeded;
extraction reads every page whole.

Defined results: null, empty and text-free pages give the empty text; text
outside any block counts as the page's own and is kept; repeated pages give
equal texts; an empty table gives no rows. Extra columns are ignored, whatever
their names are.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anualia.llm.boosted import Forest, train
from anualia.llm.common import hashed_sample
from anualia.llm.dom import Page, Vocabulary, decode, features

SAMPLE_ROWS = 300
LAYOUTS = 1_000
SEED = 20
PAGES_AT_ONCE = 200


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    forest: Forest


# ---- layouts to learn from -------------------------------------------------------

_MAIN = ["article", "main", "post", "entry content", "post-body", "story", "page-content", "articleBody", "text", "prose", "content", "entry-text", "rich-text"]
_SIDE = {
    "header": (("header", "div", "site-header", "page-header"), ["header", "masthead", "top-bar", "site-header", "page-header", "branding", "logo banner"]),
    "menu": (("nav", "div", "ul", "menu", "main-menu", "site-nav"), ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "navigation", "toc links", "skip-links", "pagination pager"]),
    "aside": (("aside", "div", "section", "related-posts", "side-bar"), ["sidebar", "side rail", "widget", "related", "recommended posts", "aside", "read-more", "popular trending", "author-bio"]),
    "advert": (("div", "aside", "p", "section", "span", "ad-slot"), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "outbrain"]),
    "notice": (("div", "section", "dialog", "p", "cookie-banner"), ["cookie", "consent", "notice", "gdpr-banner", "alert", "popup", "modal", "paywall", "cookie-notice"]),
    "form": (("form", "div"), ["newsletter", "subscribe", "signup", "login", "search", "contact-form"]),
    "share": (("div", "ul", "span", "share-buttons"), ["share", "social", "tags", "meta", "byline", "post-meta", "tools"]),
    "comments": (("section", "div", "ol", "user-comments"), ["comments", "comment-list", "responses", "replies", "disqus", "discussion", "user-comments"]),
    "footer": (("footer", "div", "site-footer", "page-footer"), ["footer", "site-footer", "bottom", "copyright", "legal", "colophon"]),
}


_COMMENTS = ["Comments", "3 comments", "Responses", "Replies", "Discussion", "Comments (12)", "Kommentare", "Commentaires", "Comentarios"]
# Inline parts of a running text, and inline parts that do not belong to it.
_TERMS = ["term", "highlight", "text", "caption", "quote", "date", "name", "note", "title"]
_TAGS_INSIDE = ["advert", "menu", "share", "ad sponsored", "promo", "social", "nav links", "tooltip hidden", "screen-reader skip"]


class Layouts:
    """Random pages with every block marked as main (1) or not (0)."""

    def __init__(self, paragraphs: list[str], seed: int = SEED):
        self._rng = random.Random(seed)
        self._paragraphs = paragraphs
        self._words = " ".join(paragraphs).split() or ["text"]

    def _some(self, low: int, high: int) -> str:
        rng = self._rng
        at = rng.randrange(len(self._words))
        return escape(" ".join(self._words[at : at + rng.randint(low, high)]))

    def _paragraph(self) -> str:
        return escape(self._rng.choice(self._paragraphs))

    def _attrs(self, names: list[str], chance: float = 0.85) -> str:
        rng = self._rng
        if rng.random() > chance:
            return ""
        key = rng.choice(["class", "class", "id"])
        return f' {key}="{rng.choice(names)}"'

    def _links(self, low: int, high: int) -> str:
        rng = self._rng
        items = [f'<a href="/x">{self._some(1, 3)}</a>' for _ in range(rng.randint(low, high))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def _inner(self, kind: str) -> str:
        rng = self._rng
        if kind in ("menu", "header"):
            start = f"<h1>{self._some(1, 5)}</h1>" if kind == "header" and rng.random() < 0.4 else ""
            line = f"<p>{self._some(2, 8)}</p>" if kind == "header" and rng.random() < 0.3 else ""
            return start + line + self._links(3, 9)
        if kind == "form":
            return f'<label>{self._some(1, 4)}</label><input name="q"><button>{self._some(1, 2)}</button>' + (f"<p>{self._some(4, 15)}</p>" if rng.random() < 0.5 else "")
        if kind == "comments":
            wrap = rng.choice(["div", "li", "article"])
            one = lambda: f"<{wrap}{self._attrs(['comment', 'reply', 'comment-body', 'response'])}><p>{self._some(1, 2)}</p><p>{rng.choice([self._paragraph(), self._some(3, 30)])}</p></{wrap}>"
            heading = rng.choice(_COMMENTS) if rng.random() < 0.6 else self._some(1, 3)
            return f"<h3>{heading}</h3>" + "".join(one() for _ in range(rng.randint(1, 5)))
        if kind == "aside":
            return f"<h3>{self._some(1, 4)}</h3>" + rng.choice([self._links(2, 7), f"<p>{self._some(5, 40)}</p>"])
        if kind == "footer":
            return rng.choice([f"&copy; {self._some(2, 25)}", self._some(3, 25), f"<p>&copy; {self._some(2, 14)}</p>" + self._links(2, 6)])
        if kind == "share":
            return rng.choice([self._links(2, 5), self._some(1, 6)])
        text = self._some(3, 25)
        return rng.choice([text, f"<p>{text}</p>", f'<a href="/x">{text}</a>', f"<p>{text}</p><button>{self._some(1, 2)}</button>"])

    def _side(self, kind: str) -> str:
        rng = self._rng
        tags, names = _SIDE[kind]
        tag = rng.choice(tags)
        # Comments are known by their heading as well, so their block has attributes less often.
        chance = 1.0 if tag == "span" else 0.6 if kind == "comments" else 0.95 if tag in ("div", "p", "section", "ul", "ol") else 0.5
        role = f' role="{rng.choice(["navigation", "banner", "complementary", "contentinfo"])}"' if rng.random() < 0.1 else ""
        inner = self._inner(kind)
        if tag in ("ul", "ol", "menu"):
            inner = f"<li>{inner}</li>"
        if tag in ("p", "span"):
            inner = re.sub(r"</?(p|ul|li|button)>", "", inner)
        return f'<{tag} data-main="0"{self._attrs(names, chance)}{role}>{inner}</{tag}>'

    def _article(self) -> str:
        rng = self._rng
        parts = [f"<h{rng.choice([1, 1, 2])}>{self._some(1, 12)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            kind = rng.random()
            text = self._paragraph() if rng.random() < 0.7 else self._some(1, 12)
            if kind < 0.75:
                start = "<p><b>" if rng.random() < 0.1 else "<p>"
                if rng.random() < 0.12:
                    text = f'{self._some(2, 9)} <span class="{rng.choice(_TERMS)}">{self._some(1, 6)}</span> {text}'
                if rng.random() < 0.08:
                    text += f' <span data-main="0" class="{rng.choice(_TAGS_INSIDE)}">{self._some(1, 6)}</span>'
                parts.append(f"{start}{text}" + ("</p>" if rng.random() < 0.85 else "<br>"))
            elif kind < 0.8:
                parts.append(f"<h2>{self._some(1, 6)}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{self._some(3, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.93:
                parts.append(f"<figure><img src=x><figcaption>{self._some(3, 12)}</figcaption></figure>")
            elif kind < 0.95:
                parts.append("<table><tr>" + "".join(f"<td>{self._some(1, 5)}</td>" for _ in range(4)) + "</tr></table>")
            else:
                parts.append(f"<div>{text}</div>")
            if rng.random() < 0.06:
                parts.append(self._side(rng.choice(["advert", "form", "share", "aside", "notice"])))
        tag = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        start, stop = ("<table><tr><td", "</td></tr></table>") if tag == "td" else (f"<{tag}", f"</{tag}>")
        return f'{start} data-main="1"{self._attrs(_MAIN, 0.7 if tag in ("div", "section") else 0.3)}>' + "".join(parts) + stop

    def page(self) -> str:
        rng = self._rng
        before = [self._side(k) for k in ("notice", "header", "menu", "advert", "form", "aside", "share") if rng.random() < 0.4]
        after = [self._side(k) for k in ("share", "comments", "aside", "advert", "form", "menu", "footer", "notice") if rng.random() < 0.4]
        rng.shuffle(before)
        middle = before + [self._article()] + after
        for _ in range(rng.choice([0, 0, 1, 2])):
            first, last = rng.randint(0, len(before)), rng.randint(len(before) + 1, len(middle))
            wrap = f'<div data-main="1"{self._attrs(["wrapper", "container", "page", "layout", "grid", "site"])}>'
            middle[first:last] = [wrap + "".join(middle[first:last]) + "</div>"]
            before = before[:first]
        return '<html><body data-main="1">' + "".join(middle) + "</body></html>"


def learn(paragraphs: list[str]) -> Model:
    """Trees over the nodes of marked pages that hold the given paragraphs."""
    layouts = Layouts(paragraphs or ["text"])
    pages = [Page(layouts.page(), marked=True) for _ in range(LAYOUTS)]
    vocabulary = Vocabulary.learn(pages)
    marks = np.array([m for p in pages for m in p.mark])
    rows = features(pages, vocabulary)
    return Model(vocabulary, train(rows[marks >= 0], (marks[marks >= 0] == 1).astype(float)))


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Model:
    """Learn from paragraphs of a bounded sample of the pages."""
    sample = hashed_sample(pages.where(F.col(html_col).isNotNull()), SAMPLE_ROWS, id_col, html_col)
    texts = F.regexp_extract_all(html_col, F.lit(r"(?is)<p\b[^>]*>([^<]{2,})"), F.lit(1))
    found = [re.sub(r"\s+", " ", t).strip() for r in sample.select(texts.alias("texts")).collect() for t in r["texts"]]
    return learn(found)


def main_texts(pages: list[Page], model: Model) -> list[str]:
    """Main text of each page."""
    odds = model.forest.log_odds(features(pages, model.vocabulary))
    texts, first = [], 0
    for page in pages:
        stop = first + len(page.tags)
        texts.append(page.text(decode(page, odds[first:stop])))
        first = stop
    return texts


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(first, PAGES_AT_ONCE)
                texts = main_texts([Page(h or "") for h in part.column(2).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(extracted, f"page_id {kinds[0]}, url {kinds[1]}, text string")
