"""Formulas and the fallback text of objects are running text."""

import time

import pytest

from anualia.llm import html_extract
from anualia.llm.dom import Page

FIRST = "The river had been rising since the early morning, and by noon the lower fields were under water."
LAST = "Nobody in the village remembered a spring like it; even the old ferryman shook his head and went home."


@pytest.fixture(scope="module")
def page_model(spark):
    return html_extract.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


@pytest.mark.parametrize("inner, text", [
    ('The flow is <math><mi>q</mi><mo>=</mo><mi>v</mi><mi>A</mi></math> by the old rule of the water board.',
     "The flow is q=vA by the old rule of the water board."),
    ('A map of the fields: <object data="map.svg"><param name="a" value="b">the fields south of the mill</object> as they were in May.',
     "A map of the fields: the fields south of the mill as they were in May."),
    ("An empty <math/> and an <object data=x /> leave the rest of the paragraph alone.",
     "An empty and an leave the rest of the paragraph alone."),
])
def test_formulas_and_fallback_texts(page_model, inner, text):
    page = f"<html><body><main><article><h1>Flood</h1><p>{FIRST}</p><p>{inner}</p><p>{LAST}</p></article></main></body></html>"
    assert html_extract.main_texts([Page(page)], page_model) == [f"Flood {FIRST} {text} {LAST}"]


BODY = f"<h1>Flood</h1><p>{FIRST}</p><p>{LAST}</p>"
WANTED = f"Flood {FIRST} {LAST}"


@pytest.mark.parametrize("page", [
    f'<body><span class="menu"><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></span><article>{BODY}</article></body>',
    f"<body><site-header><a href='/'>Home</a> <a href='/n'>News</a></site-header><main>{BODY}</main><site-footer>Copyright 2024 The Paper</site-footer></body>",
    f'<body><article><h1>Flood</h1><p>{FIRST} <span class="advert">Buy boots now</span></p><p>{LAST}</p></article></body>',
    f"<body><article>{BODY}</article><section><h3>Comments</h3><div><p>Bob</p><p>I saw it too, near the mill.</p></div>"
    f"<div><p>Ann</p><p>Same here last year.</p></div></section></body>",
    f'<body><div data-main="app"><article data-main="0">{BODY}</article></div></body>',
    f"<body><article><h1 data-main=''>Flood</h1><p DATA-MAIN='x'>{FIRST}</p><p>{LAST}</p></article></body>",
])
def test_inline_and_custom_elements(page_model, page):
    assert html_extract.main_texts([Page(f"<html>{page}</html>")], page_model) == [WANTED]


def test_spans_of_the_running_text_stay(page_model):
    page = f'<body><article><h1>Flood</h1><p><span class="lead">{FIRST}</span></p><p><span>{LAST[:30]}</span>{LAST[30:]}</p></article></body>'
    assert html_extract.main_texts([Page(page)], page_model) == [WANTED]


def test_spans_end_where_they_should():
    page = Page('<div><span class=a>x<span>y</span>z</span>w</div></span><p><span id=b>q<div>r</div>')
    assert list(zip(page.tags, page.parent)) == [("root", 0), ("div", 0), ("span", 1), ("p", 0), ("span", 3), ("div", 0)]
    assert [(n, t) for n, t in page.pieces if t.strip()] == [(2, "x"), (2, "y"), (2, "z"), (1, "w"), (4, "q"), (5, "r")]


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "</p>" * 30_000, "<video>" * 30_000, "<div><li>" * 20_000, "<span class=a>" * 30_000 + "</div>" * 30_000, "<p><span id=x>" * 20_000])
def test_reading_is_linear(page):
    began = time.process_time()
    Page(page)
    assert time.process_time() - began < 5
