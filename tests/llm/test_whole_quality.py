"""Quality classifier: scores recomputed from compressed sizes, and a curve over whole texts."""

import math

import numpy as np
import pytest
import zstandard

from anualia.llm import compression_quality as cq

SF = "/root/testdata/sf0.01"


def brute_features(model, text):
    """Compressed sizes of chunks under both dictionaries, with one plain compressor for each chunk."""
    data = (text or "").encode()
    if not data:
        return 0.0, 0.0
    sizes = []
    for dictionary in (model.good, model.bad):
        held = zstandard.ZstdCompressionDict(dictionary)
        plain = {"level": cq.LEVEL, "dict_data": held, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        sizes.append(sum(len(zstandard.ZstdCompressor(**plain).compress(data[i : i + cq.CHUNK])) for i in range(0, len(data), cq.CHUNK)))
    return (sizes[1] - sizes[0]) / len(data), sizes[0] / len(data)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_scores_equal_a_plain_recomputation(spark, tables):
    docs, labels = tables
    model = cq.fit(docs, labels)
    scores = {r.doc_id: r.score for r in cq.score(docs, model).collect()}
    assert len(scores) == docs.count()
    for r in docs.limit(150).collect():
        difference, rate = brute_features(model, r.text)
        z = model.curve[0] + model.curve[1] * difference + model.curve[2] * rate
        assert scores[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_the_curve_sees_whole_texts_of_its_own_half(spark, tables):
    docs, labels = tables
    sample, _ = cq._labelled(docs, labels, "doc_id", "text", cq.SAMPLE_ROWS)
    model = cq.Model(*(cq._dictionary(cq._fragments(sample, cq.SAMPLE_ROWS)[v]) for v in (1, 0)), (0.0, 0.0, 0.0))
    texts = [r for r in sample.where("half = 1").collect()]
    assert max(len(r["bytes"]) for r in texts) > 4 * cq.FRAGMENT
    want = sorted((r["label"], *brute_features(model, bytes(r["bytes"]).decode())) for r in texts)
    points, kinds = cq._measures(sample, model, cq.SAMPLE_ROWS)
    assert np.allclose(sorted(zip(kinds, *points.T)), want)
    used = {r["doc_id"] for r in sample.select("doc_id").collect()}
    assert not any(r.held for r in docs.where(docs.doc_id.isin(list(used))).select(cq.held_out(docs.doc_id).alias("held")).collect())


def test_one_id_on_most_rows(spark):
    """A hot id cannot fill the sample beyond its bound."""
    rows = [(1, f"same id, text {i} of many") for i in range(300)] + [(i, f"another text {i}") for i in range(2, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 90)], "doc_id long, quality int")
    sample, _ = cq._labelled(docs, labels, "doc_id", "text", 40)
    assert all(len(v) <= 20 for v in cq._fragments(sample, 40).values())
    assert sample.count() < 4 * 20 * 1.2 * 2.5
