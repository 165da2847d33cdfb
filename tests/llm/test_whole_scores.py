"""Language model: all contexts, for words and inside spelled words, and learning through whole texts."""

import math

import numpy as np
import pyarrow as pa
import pytest

from anualia.llm import context_mixing as cm, language_model


def test_each_decision_has_one_two_and_three_symbols_before_it():
    a = cm.Alphabet.build([f"w{i}" for i in range(9)], np.ones(cm.FIRST_WORD + 9, np.int64))

    def last(text, at):
        spelled = a.spell(pa.array([text]))
        return [int(h[at]) for h in spelled.contexts()[0]]

    # The word w4 after other words, then the byte "d" of a spelled word: only contexts that reach the change differ.
    for texts, at in (
        (("w0 w1 w2 w3 w4", "w0 w1 w2 w8 w4", "w0 w1 w8 w3 w4", "w0 w8 w2 w3 w4", "w8 w1 w2 w3 w4"), 4),
        (("zabcd", "zabxd", "zaxcd", "zxbcd", "xabcd"), 4),
    ):
        plain, *changed = [last(t, at) for t in texts]
        assert [[x == y for x, y in zip(plain, c)] for c in changed] == [
            [False, False, False], [True, False, False], [True, True, False], [True, True, True],
        ]


def sequential_bits(model, text):
    """The model's cost of one text, decision by decision; weights are refined after each block, to the end of the text."""
    a = model.alphabet
    symbols = a.spell(pa.array([text])).symbols
    tables = model.tables.astype(np.float64) / cm.ODDS_STEPS
    weights = model.weights.astype(np.float64)
    total, pending = 0.0, np.zeros_like(weights)
    for place, symbol in enumerate(symbols):
        if place % cm.BLOCK == 0:
            weights, pending = weights + pending, np.zeros_like(weights)
        value, hashes = 0, []
        for back in range(1, 4):
            before = int(symbols[place - back]) if place >= back else cm.TEXT_END
            value = (value + before + back) * int(cm._MIX[back - 1]) & 0xFFFFFFFF
            value ^= value >> 15
            hashes.append(value)
        spelling = int(place > 0 and symbols[place - 1] < cm.WORD_END)
        first = int(a.start[symbol])
        for depth in range(int(a.length[symbol])):
            node, bit = int(a.nodes[first + depth]), int(a.bits[first + depth])
            gate = min(depth, cm.DEPTHS - 1) * 2 + spelling
            slots = [((h ^ node * int(cm._NODE) & 0xFFFFFFFF) * int(cm._SPREAD) & 0xFFFFFFFF) >> 32 - model.table_bits for h in hashes]
            x = np.array([model.node_odds[node], *(t[s] for t, s in zip(tables, slots)), 1.0])
            z = float(weights[gate] @ x)
            z = max(-15.0, min(15.0, z if bit else -z))
            total += math.log2(1 + math.exp(-z))
            pending[gate] += (1 if bit else -1) * (1 - 1 / (1 + math.exp(-z))) * cm.RATE * x
    return total


def test_scores_equal_coding_decision_by_decision(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trained = language_model.fit(docs)
    scores = {r.doc_id: r.score for r in language_model.score(docs, trained).collect()}
    texts = sorted((r.doc_id, r.text) for r in docs.collect() if len(r.text) < 30_000)
    texts = texts[:15] + sorted(texts, key=lambda r: len(r[1]))[-3:]
    assert max(len(trained.model.alphabet.spell(pa.array([t])).symbols) for _, t in texts) > 5 * cm.SEGMENT
    for i, t in texts:
        assert scores[i] == pytest.approx(-sequential_bits(trained.model, t) * math.log10(2), rel=1e-3)


def test_what_a_text_taught_is_kept_to_its_end():
    """A long text of one kind costs less and less, past any segment, and each predictor's weight is refined."""
    rng = np.random.default_rng(0)
    a = cm.Alphabet.build([f"w{i}" for i in range(64)], np.append(np.zeros(cm.FIRST_WORD, np.int64), np.full(64, 100)))
    odds = np.zeros(int(a.nodes.max()) + 1, np.float32)
    some = [f"w{i}" for i in rng.integers(0, 64, 6000)]
    cells = cm.count(a, [a.spell(pa.array([" ".join(some)]))], 18)
    model = cm.Model(a, odds, cm.stretched(cells).reshape(cm.ORDERS, -1), np.full((2 * cm.DEPTHS, cm.ORDERS + 2), 0.01, np.float32))
    starts = [0, 256, 512, 1024, 2048, 4096]
    bits = model.bits(a.spell(pa.array([" ".join(some[: s + 256]) for s in starts] + [" ".join(some[:s]) for s in starts])), 2 * len(starts))
    each = bits[: len(starts)] - bits[len(starts) :]
    assert (np.diff(each) < 0).all() and each[-1] < each[1] * 0.8


def test_counts_equal_counting_decision_by_decision():
    """Every step of every symbol, in the place of its context and node, however often a symbol follows a context."""
    rng = np.random.default_rng(1)
    a = cm.Alphabet.build([f"w{i}" for i in range(20)], rng.integers(0, 99, cm.FIRST_WORD + 20))
    texts = [" ".join(rng.choice([f"w{i}" for i in range(20)] + ["abc", "é"], n)) for n in (0, 1, 300, 900)]
    spelled = a.spell(pa.array(texts + [None]))
    want = np.zeros((cm.ORDERS, 1 << 18, 2), np.int64)
    hashes, _ = spelled.contexts()
    for k, symbol in enumerate(spelled.symbols.tolist()):
        for s in range(int(a.start[symbol]), int(a.start[symbol] + a.length[symbol])):
            for order, h in enumerate(hashes):
                place = ((int(h[k]) ^ int(a.nodes[s]) * int(cm._NODE) & 0xFFFFFFFF) * int(cm._SPREAD) & 0xFFFFFFFF) >> 14
                want[order, place, int(a.bits[s])] += 1
    assert (cm.count(a, [spelled], 18) == want.reshape(-1)).all()


def test_tables_grow_with_the_training_text():
    sizes = [cm.table_bits(n) for n in (0, 10**6, 10**8, 10**9, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == cm.LEAST_BITS and sizes[-1] == cm.MOST_BITS and len(set(sizes)) > 2


def test_start_weights_do_not_hang_on_the_order_of_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (language_model.fit(d).model for d in (docs, docs.orderBy("text").repartition(3)))
    assert (one.tables == two.tables).all() and np.allclose(one.weights, two.weights, atol=0.05)
