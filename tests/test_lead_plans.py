"""Sitemap entries are never sent through the driver, and a site's urls are found once."""

import pytest

from fitgrid.operators import leads
from fitgrid.plans.catalog import all_queries
from test_scale import SMALL, broadcast_parts

QUERIES = all_queries()


@pytest.mark.parametrize("name", ["sitemap_urls", "sitemap_classification", "lead_order"])
def test_sitemap_entries_join_by_key(spark, monkeypatch, name):
    plans, keep = [], leads.checkpointed

    def seen(df):
        plans.append(df)
        return keep(df)
    monkeypatch.setattr(leads, "checkpointed", seen)
    plans.append(QUERIES[name](spark, SMALL))
    assert len(plans) > 3
    for df in plans:
        for part in broadcast_parts(df):
            assert "Generate" not in part and "Scan ExistingRDD" not in part


@pytest.mark.parametrize("name", ["sitemap_classification", "lead_order"])
def test_sitemaps_are_read_once_for_all_their_uses(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all(xml" not in plan
