"""HTML extraction, language model and pipeline."""

import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from anualia.llm import pipeline
from anualia.llm import (
    compression_quality, context_mixing as cm, html_extract, language_model, mixing, near_duplicates, queries,
)
from anualia.llm.boosted import train
from anualia.llm.dom import Page, decode
from tests.llm.conftest import odd_rows
from tests.llm.test_text_operators import SF, brute_components, brute_fingerprint, brute_targets, words

# ---- HTML ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def page_model(spark):
    return html_extract.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_given_pages(spark):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op1_html_extract(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        inner = re.sub(r"<[^>]*\Z", "", re.search(r"(?s)<article>(.*?)(</article>|\Z)", rows[r.page_id])[1])
        want = " ".join(html.unescape(re.sub(r"(?s)<[^>]*>", " ", inner)).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_odd_pages(spark, page_model):
    pages = [None, "", "   ", "plain text only", "<p>one<p>two", "<", "<a", "a < b & c &amp; d &#233;", "<script>x</script>", "<p>" * 3000 + "deep",
             "<div>" * 3000 + "deep", "<!-- open", "<style>p{}", "</div></p>x", "<p title='a>b'>in</p>", "<title>t</title>", "<p>dup</p>", "<p>dup</p>",
             "<article><p>" + "word " * 50_000 + "</p></article>"]
    df = spark.createDataFrame([(i, None if i % 2 else "u", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(df, page_model).collect()}
    assert len(got) == len(pages) and got[0] == got[1] == got[2] == got[8] == got[12] == ""
    assert got[3] == "plain text only" and got[7] == "a < b & c & d é" and got[16] == got[17]
    assert len(got[18].split()) == 50_000
    none = df.limit(0)
    assert html_extract.extract(none, html_extract.fit(none)).count() == 0


def test_parts_of_a_page(page_model):
    first = "The river had been rising since the early morning, and by noon the lower fields were under water."
    second = "Nobody in the village remembered a spring like it; even the old ferryman shook his head and went home."
    page = f"""<html><head><title>Flood</title><script>var a = "<p>no</p>";</script></head><body>
    <header class="site-header"><h1>The Daily</h1><ul class="menu"><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></header>
    <div class="cookie-notice"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
    <div class="wrapper"><aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>Drought last year</a></li></ul></aside>
    <main class="content"><article><h1>Flood</h1><p>{first}</p><div class="ad">Buy new boots today</div><p>Short.</p><p>{second} It&rsquo;s&nbsp;true.</p>
    <form class="newsletter"><label>Your mail</label><input name=m><button>Subscribe</button></form></article></main></div>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>Ann</p><p>My cellar is full of water as well, what a mess this is.</p></div></section>
    <footer>&copy; The Daily, all rights reserved</footer></body></html>"""
    assert html_extract.main_texts([Page(page)], page_model) == [f"Flood {first} Short. {second} It’s true."]


def test_unseen_layouts(page_model):
    """Accuracy by words on layouts drawn with another seed."""
    rng = np.random.default_rng(5)
    paragraphs = [" ".join(f"w{rng.integers(500)}" for _ in range(rng.integers(8, 60))) for _ in range(80)]
    layouts = html_extract.Layouts(paragraphs, seed=99)
    pages = [Page(layouts.page(), marked=True) for _ in range(200)]
    right = wrong = missed = 0
    for page, text in zip(pages, html_extract.main_texts(pages, page_model)):
        want = Counter(page.text([m == 1 for m in page.mark]).split())
        got = Counter(text.split())
        right, wrong, missed = right + (got & want).total(), wrong + (got - want).total(), missed + (want - got).total()
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_decoding_is_consistent_and_best():
    page = Page("<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    rng = np.random.default_rng(0)
    n = len(page.tags)
    for _ in range(50):
        odds = rng.normal(size=n)
        kept = decode(page, odds)
        assert all(kept[page.parent[i]] or not kept[i] for i in range(n))
        best = -np.inf
        for mask in range(1 << n - 1):
            some = [True, *(bool(mask >> i & 1) for i in range(n - 1))]
            if all(some[page.parent[i]] or not some[i] for i in range(n)):
                best = max(best, sum(o for o, k in zip(odds[1:], some[1:]) if k))
        assert sum(o for o, k in zip(odds[1:], kept[1:]) if k) == pytest.approx(best)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = train(x[:1500], y[:1500])
    assert ((forest.log_odds(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95
    assert (train(x[:5], np.ones(5)).log_odds(x) > 0).all()


# ---- language model --------------------------------------------------------------


def brute_base(rows):
    train_rows = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train_rows for w in (t or "").encode().lower().split())
    end, total = len(train_rows), sum(counts.values()) + len(train_rows)
    distinct = len(counts) + (end > 0)
    out = Counter()
    for i, t in rows:
        found = [counts[w] for w in (t or "").encode().lower().split()] + [end]
        score = sum(math.log10((c + 1) / (total + distinct + 1)) for c in found)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        out[i, held, len(found), sum(c > 0 for c in found), total, round(score, 5)] += 1
    return out


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    trained = language_model.fit(docs)
    got = language_model.score(docs, trained).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == brute_base(rows)
    scores = {r.doc_id: r for r in got}
    for i, t in rows:
        assert scores[i].bits_per_byte == pytest.approx(-scores[i].score / math.log10(2) / max(len(t.encode()), 1))
    # Contexts help on texts that were not learned from: the same model without counts in its contexts does worse.
    blind = cm.Model(trained.model.alphabet, trained.model.node_odds, np.zeros_like(trained.model.tables), trained.model.weights)
    held = [(i, t) for i, t in rows if scores[i].held_out]
    without = float(blind.bits(blind.alphabet.spell(pa.array([t for _, t in held])), len(held)).sum()) * -math.log10(2)
    assert sum(scores[i].score for i, _ in held) > without * 0.98


def test_language_model_on_odd_rows(spark, docs, no_docs):
    trained = language_model.fit(docs)
    got = language_model.score(docs, trained).collect()
    want = brute_base([(r[0], r[1]) for r in odd_rows()])
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    nothing = language_model.fit(no_docs)
    assert language_model.score(no_docs, trained).count() == 0
    assert {r.n_known for r in language_model.score(docs, nothing).collect()} == {0}


def test_alphabet_is_a_prefix_code():
    weights = np.random.default_rng(0).integers(0, 1000, 300)
    a = cm.Alphabet.build([f"w{i}" for i in range(42)], weights)
    codes = {"".join(map(str, a.bits[s : s + n])) for s, n in zip(a.start, a.length)}
    assert len(codes) == 300 and sum(2.0 ** -len(c) for c in codes) == 1.0
    spelled = a.spell(pa.array([" W1 zz w41\tq\n", None, "", "w0"]))
    assert spelled.symbols.tolist() == [259, 122, 122, 256, 299, 113, 256, 257, 257, 257, 258, 257]
    assert spelled.text.tolist() == [0] * 8 + [1, 2, 3, 3] and spelled.place.tolist() == [*range(8), 0, 0, 0, 1]
    assert spelled.rest.to_pylist() == ["zz", "q"] and spelled.rest_text.tolist() == [0, 0]
    assert len(a.spell(pa.array([], pa.string())).symbols) == 0


def test_long_texts_are_coded_in_pieces_alike(monkeypatch):
    rng = np.random.default_rng(0)
    a = cm.Alphabet.build([], rng.integers(1, 50, cm.FIRST_WORD))
    odds = language_model._node_odds(a, rng.integers(1, 50, cm.FIRST_WORD))
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(1500)]
    spelled = a.spell(pa.array([" ".join(words), " ".join(words[:200]), ""]))
    found = []
    for size in (1 << 20, 1024, 1):
        monkeypatch.setattr(cm, "PIECE", size)
        monkeypatch.setattr(cm, "COUNTED_AT_ONCE", size)
        cells = cm.count(a, [spelled], 18)
        model = cm.Model(a, odds, cm.stretched(cells).reshape(cm.ORDERS, -1), np.full((2 * cm.DEPTHS, cm.ORDERS + 2), 0.5, np.float32))
        found.append((cells, model.bits(spelled, 3)))
    for cells, bits in found[1:]:
        assert (cells == found[0][0]).all() and bits == pytest.approx(found[0][1], rel=1e-5)


def test_packed_pages_add_up():
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, top, language_model.PAGE) for top in (1, 3, 300, 1 << 40)]
    total = np.zeros(language_model.PAGE, np.int64)
    for p in pages:
        language_model._add(total, language_model._pack(p))
    assert (total == sum(pages)).all()


# ---- pipeline ----------------------------------------------------------------------


def test_pipeline_by_brute_force(spark):
    """Each stage against its decision worked out row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    model = compression_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    judge = compression_quality.Compressors(model)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "mix", "token ids"]

    good = stages["quality classifier"](spark, docs, SF)
    want = {r.doc_id: r for r in docs.collect() if judge.score(r.text.encode()) >= 0.5}
    assert good.columns == names and {r.doc_id: r for r in good.collect()} == want

    one = stages["near-duplicates"](spark, good, SF)
    classes = brute_components({i: brute_fingerprint(r.text) for i, r in want.items()}, 2)
    want = {i: want[i] for i in set(classes.values())}
    assert one.columns == names and {r.doc_id: r for r in one.collect()} == want

    clean = stages["decontamination"](spark, one, SF)

    def shingles(text):
        w = re.findall(r"[^\W_]+", text.lower())
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i: r for i, r in want.items() if not any(len(s & shingles(r.text)) >= 0.8 * len(s) for s in items)}
    assert clean.columns == names and {r.doc_id: r for r in clean.collect()} == want

    mixed = stages["mix"](spark, clean, SF)
    sizes = Counter()
    for r in want.values():
        sizes[r.source] += len(words(r.text))
    targets = brute_targets(dict(sizes))
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == names and set(times) <= set(want) and max(times.values()) <= 3
    for s in sizes:
        own = [r for r in want.values() if r.source == s]
        taken = sum(times[r.doc_id] * len(words(r.text)) for r in own)
        assert abs(taken - targets[s]) <= max(len(words(r.text)) for r in own)

    tokenizer = Tokenizer.from_file(pipeline.TOKENIZER)
    ids = stages["token ids"](spark, mixed, SF)
    start, expected = 0, []
    for i in sorted(times.elements()):
        found = np.array(tokenizer.encode(want[i].text, add_special_tokens=False).ids + [2], "<u4")
        expected.append((i, start, len(found), zlib.crc32(found.tobytes())))
        start += len(found)
    assert sorted(map(tuple, ids.collect()), key=lambda r: r[1]) == expected
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1]) == expected


def test_pipeline_stages_on_odd_rows(spark, docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, no_docs):
            got = stage(spark, table, SF)
            assert got.count() <= 3 * table.count()
            assert name == "token ids" or got.columns == docs.columns
