"""Start weights of the mixing come from every training text."""

import zlib

import numpy as np
import pyarrow as pa

from anualia.llm import context_mixing as cm, language_model


def test_start_weights_are_fitted_on_every_text(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60, 20 + i % 50))) for i in range(1_500)]
    rows += [(2_000, None), (2_001, ""), (2_002, " ".join("xyz" * k for k in range(1, 40)))]
    model = language_model.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).model
    a = model.alphabet
    spelled = a.spell(pa.array([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], pa.string()))
    cells = cm.count(a, [spelled], model.table_bits)
    both = cm.stretched(cells).view(np.uint8).astype(np.uint16) << 8 | cm.sizes(cells).view(np.uint8)
    want = cm.fit_weights(cm.weight_sums(a, model.node_odds, both.reshape(cm.ORDERS, -1), [spelled]))
    assert np.allclose(model.weights, want, atol=1e-3)


def test_sums_equal_decision_by_decision():
    rng = np.random.default_rng(1)
    a = cm.Alphabet.build([f"w{i}" for i in range(20)], np.append(np.zeros(cm.FIRST_WORD, np.int64), rng.integers(1, 99, 20)))
    odds = rng.normal(size=int(a.nodes.max()) + 1).astype(np.float32)
    spelled = a.spell(pa.array([" ".join(f"w{i}" for i in rng.integers(0, 22, 300)), None, "w1"]))
    cells = cm.count(a, [spelled], 18)
    tables, seen = cm.stretched(cells).reshape(cm.ORDERS, -1), cm.sizes(cells).reshape(cm.ORDERS, -1)
    want = np.zeros((cm.DEPTHS * 2, cm.ORDERS + 3, cm.ORDERS + 2))
    hashes, after = spelled.contexts()
    for k, s in enumerate(spelled.symbols.tolist()):
        path, steps = a.path(np.array([s]))
        for j in range(int(steps[0])):
            y, x = int(a.bits[path[j]]), [float(odds[a.nodes[path[j]]])]
            for table, known, h in zip(tables, seen, hashes):
                at = cm.slots(a, path[j : j + 1], np.array([1]), h[k : k + 1], 18)[0]
                share, total = 1 / (1 + np.exp(-float(table[at]) / cm.ODDS_STEPS)), np.exp2(known[at] / 8) - 1 + 2 * cm.PRIOR
                ones, zeros = max(share * total - cm.PRIOR - y, 0), max((1 - share) * total - cm.PRIOR - (1 - y), 0)
                x.append(np.log((ones + cm.PRIOR) / (zeros + cm.PRIOR)))
            x = np.array([*x, 1.0])
            p = 1 / (1 + np.exp(-np.clip(cm.START @ x, -15, 15)))
            gate = int(a.gate[path[j]]) + int(after[k])
            want[gate, 0] += (y - p) * x
            want[gate, 1:] += p * (1 - p) * np.outer(x, x)
    both = tables.view(np.uint8).astype(np.uint16) << 8 | seen.view(np.uint8)
    assert np.allclose(cm.weight_sums(a, odds, both, [spelled]), want, rtol=1e-3, atol=1e-2)
