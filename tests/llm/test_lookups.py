"""Language model: what is the same is looked up once."""

import numpy as np
import pyarrow as pa

from anualia.llm import context_mixing as cm


def alphabet(rng):
    return cm.Alphabet.build([f"w{i}" for i in range(20)], np.append(np.zeros(cm.FIRST_WORD, np.int64), rng.integers(1, 99, 20)))


def test_sums_of_a_repeated_text_take_the_lookups_of_one(monkeypatch):
    rng = np.random.default_rng(0)
    a = alphabet(rng)
    odds = rng.normal(size=int(a.nodes.max()) + 1).astype(np.float32)
    text = " ".join(f"w{i}" for i in rng.integers(0, 23, 400))
    both = rng.integers(0, 1 << 16, (cm.ORDERS, 1 << 18)).astype(np.uint16) & 0x7F7F
    levels, seen = cm.Alphabet.levels, []

    def spied(self, symbols):
        for depth, first, steps in levels(self, symbols):
            seen.append(len(steps))
            yield depth, first, steps

    monkeypatch.setattr(cm.Alphabet, "levels", spied)
    found, costs = [], []
    for copies in (1, 40):
        seen.clear()
        found.append(cm.weight_sums(a, odds, both, [a.spell(pa.array([text] * copies))]) / copies)
        costs.append(sum(seen))
    assert costs[0] == costs[1] > 0
    assert np.allclose(found[0], found[1], rtol=1e-4, atol=1e-3)


def test_contexts_that_differ_are_kept_apart():
    """Equal symbols and equal hashes of three symbols are not enough: all hashes must be the same."""
    symbols = np.array([5, 5, 5, 4, 5], np.uint64)
    hashes = [np.array(h, np.uint32) for h in ([1, 2, 1, 1, 1], [7, 7, 7, 7, 7], [9, 9, 9, 9, 9])]
    places, times = cm._alike(symbols, hashes)
    rows = [(int(symbols[p]), int(hashes[0][p])) for p in places]
    total = {row: sum(int(t) for r, t in zip(rows, times) if r == row) for row in rows}
    assert rows == sorted(rows, key=lambda r: r[0]) and total == {(4, 1): 1, (5, 1): 3, (5, 2): 1}


def test_words_of_several_arrays_are_looked_up_in_one_go(monkeypatch):
    a = alphabet(np.random.default_rng(1))
    several = [pa.array(["w1 zz W2", None]), pa.array([], pa.string()), pa.array(["", " \t"]), pa.array(["w3", "q w19"])]
    alone = [a.spell(texts) for texts in several]
    index_in, calls = cm.pc.index_in, []
    monkeypatch.setattr(cm.pc, "index_in", lambda *x, **more: calls.append(1) or index_in(*x, **more))
    found = list(a.spell_each(several))
    assert len(calls) == 1 and len(found) == len(alone) and list(a.spell_each([])) == []
    for one, other in zip(found, alone):
        assert one.symbols.tolist() == other.symbols.tolist() and one.text.tolist() == other.text.tolist()
        assert one.place.tolist() == other.place.tolist() and one.rest.to_pylist() == other.rest.to_pylist()
