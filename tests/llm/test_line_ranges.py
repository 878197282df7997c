"""Lines whose holders fill many ranges, beside lines inside one range."""

import random
from collections import defaultdict

from fitgrid.llm import line_dedup


def test_frequent_lines_over_many_ranges(spark):
    pick = random.Random(3)
    common = [f"a line of more than twenty characters, number {k}" for k in range(30)]
    rows = []
    for i in range(1500):
        lines = [common[0]] * pick.randint(1, 2) + pick.choices(common, weights=[40] + [1] * 29, k=3) + [f"a line of its own in document {i}", "short"]
        pick.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    holders = defaultdict(set)
    for i, text in rows:
        for line in text.split("\n"):
            if len(line) >= 20:
                holders[line].add(i)
    want = {i: "\n".join(x for x in text.split("\n") if len(holders[x]) < 3 or max(holders[x]) == i) for i, text in rows}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for ranges in ("3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
