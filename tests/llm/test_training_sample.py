"""The tagger's training sample: which labelled texts are in it when some are long, missing or repeated."""

import zlib
from collections import Counter

import pytest

from fitgrid.llm import toxicity

IDS = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
LABELS = [(i, i % 2) for i in IDS]


def tables(spark, texts, labels):
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def in_pick_order(spark, ids):
    table = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return [r.doc_id for r in table.selectExpr("doc_id", "xxhash64(3, doc_id) as pick").orderBy("pick").collect()]


def test_a_long_text_does_not_end_the_sample(spark):
    order = in_pick_order(spark, IDS)
    for long in (order[0], order[len(order) // 2]):
        texts = [(i, "a" * 5000 if i == long else "b" * 10) for i in IDS]
        rows = toxicity.training_rows(*tables(spark, texts, LABELS), max_chars=4000)
        assert {r.doc_id for r in rows} == set(IDS) - {long}


def test_each_class_fills_up_over_all_picks(spark):
    texts = [(i, "c" * (700 if k % 3 == 0 else 5)) for k, i in enumerate(in_pick_order(spark, IDS))]
    rows = toxicity.training_rows(*tables(spark, texts, LABELS), per_class=60, max_chars=15_000)
    assert Counter(r.toxic for r in rows) == {0: 60, 1: 60}
    assert sum(len(r.text) for r in rows) <= 15_000
    one_sided = [(i, t[:5] if i % 2 else t) for i, t in texts]
    rows = toxicity.training_rows(*tables(spark, one_sided, LABELS), per_class=60, max_chars=15_000)
    assert sum(len(r.text) for r in rows if r.toxic == 0) > 7_500  # what the toxic class leaves


def test_labels_without_document_take_no_place(spark):
    order = in_pick_order(spark, IDS)
    texts = [(i, "d") for i in order[len(order) // 2:]]
    rows = toxicity.training_rows(*tables(spark, texts, LABELS), per_class=30)
    assert Counter(r.toxic for r in rows) == {0: 30, 1: 30}


def test_a_class_without_texts_is_an_error(spark):
    docs, labels = tables(spark, [(i, "e") for i in IDS if i % 2 == 0], LABELS)
    with pytest.raises(ValueError, match="both classes"):
        toxicity.tagger_for(docs, labels)
    assert toxicity.tagger_for(docs.limit(0), labels).weights == {}
    assert toxicity.tagger_for(docs, labels.where("toxic = 0")).weights == {}


def test_repeated_ids_are_bounded_by_text(spark):
    hot = IDS[0]
    texts = [(i, "f") for i in IDS] + [(hot, "g" * 100)] * 300 + [(hot, f"h{n}") for n in range(200)]
    texts += [(hot, None), (hot, "")] * 50
    rows = toxicity.training_rows(*tables(spark, texts, LABELS), per_class=1000, max_chars=2000)
    assert len({(r.doc_id, r.text) for r in rows}) == len(rows) == len(IDS) + 202
    assert sum(len(r.text) for r in rows) <= 2000
    rows = toxicity.training_rows(*tables(spark, texts, LABELS), per_class=100)
    assert Counter(r.toxic for r in rows) == {0: 100, 1: 100}
    assert len({r.doc_id for r in rows}) == 200  # first texts of other ids before further ones of one
    rows = toxicity.training_rows(*tables(spark, texts, LABELS), per_class=1000, max_chars=700)
    assert sum(len(r.text) for r in rows) <= 700
