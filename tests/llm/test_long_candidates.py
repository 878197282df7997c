"""Loose candidates of personal data are whole however long they are."""

from fitgrid.llm import pii


def test_long_candidates_are_whole(spark):
    key = "password=" + "a1" * 150
    address = "b" * 80 + " [at] " + "c" * 70 + " [dot] org"
    texts = [(1, f"{key} end"), (2, f"{address}, end"), (3, "d" * 200_000 + " token=" + "e2" * 100_000), (4, "f.[at]" * 30_000)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r.doc_id, pii.KINDS[r.kind]): (r.start, r.end, r.edges) for r in pii.candidates(table).collect()}
    assert found[1, "secret"] == (0, len(key), 2)
    assert found[2, "email"] == (0, len(address), 2)
    assert found[3, "secret"] == (200_001, 400_007, 2)
