"""How often a written step names what it reads: the driver plans and holds every copy."""

import random

import pytest

from fitgrid.llm import components, jaccard


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


@pytest.fixture
def written(monkeypatch):
    found, stored = [], jaccard.stored

    def counted(df, label):
        found.append((label, scans(df)))
        return stored(df, label)
    for module in (components, jaccard):
        monkeypatch.setattr(module, "stored", counted)
    return found


def test_a_round_names_its_links_four_times(spark, written, tmp_path):
    links = [(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 40), (50, 50), (60, 1), (60, 2)]
    spark.createDataFrame(links, "a long, b long").write.parquet(str(tmp_path / "links"))
    found = components.connected_components(spark.read.parquet(str(tmp_path / "links"))).collect()
    assert {r.id: r.component for r in found} == dict.fromkeys([*range(1, 31), 60], 1) | {40: 40, 41: 40}
    assert len(found) == 33
    assert max(n for _, n in written) <= 4


def test_steps_of_the_join_stay_small(spark, written):
    rng = random.Random(4)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(48):
        text = list(words[i % 6])
        text[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(documents).collect()}
    assert found == {i: i % 6 for i in range(48)}
    assert {label for label, _ in written} >= {"sides", "moved", "every", "links"}
    assert max(n for _, n in written) <= 12, written
