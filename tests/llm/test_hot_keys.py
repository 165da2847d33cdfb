"""Keys that a third of all rows share: joins beyond the broadcast bounds give what broadcasts give."""

import pytest
from pyspark.sql import functions as F

from anualia.llm import common, components, decontaminate, near_duplicates
from tests.llm.conftest import prose

PHRASE = "as it was said before in the notes of this page"


def tables(spark):
    item = prose(40, 30)
    docs = [(i, f"{prose(100 + i, 20)} {PHRASE} {prose(300 + i, 20)}") for i in range(40)]
    docs += [(100 + i, f"{prose(500 + i, 10)} {item}") for i in range(20)] + [(None, item), (None, item), (7, item), (8, None), (9, "")]
    items = [(1, item), (2, PHRASE), (3, "one two"), (3, PHRASE), (4, None), (5, prose(41, 600))]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def found(docs, benchmark):
    return sorted(decontaminate.matches(docs, benchmark).collect(), key=str)


@pytest.mark.parametrize("bound", [{"BROADCAST_ROWS": 0}, {"BROADCAST_BYTES": 10}])
def test_decontamination_beyond_the_broadcast_bounds(spark, monkeypatch, bound):
    docs, items = tables(spark)
    want = found(docs, items)
    assert {(r.doc_id, r.item_id) for r in want} >= {(0, 2), (0, 3), (39, 2), (100, 1), (119, 1), (None, 1), (7, 1)}
    for name, value in bound.items():
        monkeypatch.setattr(common, name, value)
    assert found(docs, items) == want


def test_salted_join_is_an_inner_join(spark):
    rows = spark.createDataFrame([(i, 1 if i % 3 else i, "x") for i in range(60)] + [(60, None, "x")], "id long, key long, size string")
    table = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (99, "d"), (None, "e")], "key long, value string")
    got = common.salted_join(rows, table, "key", F.col("id"))
    assert got.columns == rows.join(table, "key").columns
    assert sorted(got.collect()) == sorted(rows.join(table, "key").collect())


def test_one_component_with_most_nodes(spark):
    """A chain, which needs many rounds, and a star, in which all nodes name one."""
    links = [(i, i + 1) for i in range(70)] + [(1000, i) for i in range(1001, 1200)]
    edges = spark.createDataFrame(links + [(b, a) for a, b in links], "a long, b long")
    nodes = edges.select(F.col("a").alias("node")).distinct().select("node", F.struct("node").alias("label"))
    got = {r.node: r.label.node for r in components.least_labels(edges, nodes).collect()}
    assert got == {n: 0 for n in range(71)} | {n: 1000 for n in range(1000, 1200)}


def test_near_duplicates_with_hot_fingerprints(spark, monkeypatch):
    base = prose(60, 40)
    rows = [(i, base) for i in range(30)] + [(50 + i, "") for i in range(20)] + [(None, base), (None, None), (7, base)]
    rows += [(200 + i, prose(700 + i, 30)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(near_duplicates.classes(docs).collect(), key=str)
    assert len(want) == len(rows) and {r.component_id for r in want} == {0, 50, *range(200, 210)}
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(near_duplicates.classes(docs).collect(), key=str) == want
