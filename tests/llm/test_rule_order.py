"""Scripts without case, and an order of rules that does not change from run to run."""

import pytest
from pyspark.sql import functions as F

from anualia.llm import rules

SENTENCES = {
    "Arabic": "كان النهر يرتفع منذ الصباح الباكر وعند الظهر كانت الحقول المنخفضة تحت الماء",
    "Hebrew": "הנהר עלה מאז הבוקר המוקדם ובצהריים היו השדות הנמוכים מתחת למים",
    "Hindi": "नदी सुबह से बढ़ रही थी और दोपहर तक निचले खेत पानी के नीचे थे",
    "Korean": "강물은 이른 아침부터 불어나고 있었고 정오에는 낮은 들판이 물에 잠겨 있었다",
    "English": "The river had been rising since the early morning and by noon the lower fields were under water",
}


@pytest.mark.parametrize("language", SENTENCES)
def test_texts_of_every_script_are_kept(spark, language):
    words = SENTENCES[language].split()
    text = " ".join(f"{w}{chr(0x61 + k) if language == 'English' else ''}" for k in range(4) for w in words[k:] + words[:k])
    docs = spark.createDataFrame([(1, text), (2, "12 -- 34 ** 5 " * 9), (3, text + " !")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in rules.measured(docs).collect()}
    assert got[2] is False
    verdicts = docs.select(F.col("text")).select("text", F.split("text", " ").alias("words"))
    few = next(r for r in rules.default_rules() if r.name == "few_letters")
    assert [r[0] for r in verdicts.select(few.rejects).collect()] == [False, True, False]


def test_order_is_by_rejection_per_cost_and_stable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = F.crc32(F.col("text").cast("binary")) % 2 == 0
    costly = F.size(F.array_distinct(F.transform("words", lambda w: F.sha2(w, 256)))) >= 0
    some = [
        rules.Rule("a_costly", costly & half), rules.Rule("b_rare", F.crc32(F.col("text").cast("binary")) % 64 == 0),
        rules.Rule("c_cheap", half), rules.Rule("d_never", F.size("words") < 0),
    ]
    for _ in range(2):
        order = [r.name for r in rules.order_rules(docs, some)]
        assert order[0] == "c_cheap" and order[-1] == "d_never" and order.index("a_costly") > order.index("c_cheap")
