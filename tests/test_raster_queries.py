"""Queries on rasters: what each tells of a page."""

from attestra.plans import queries


def test_changed_ratio_tells_pages_with_and_without_a_change(spark, sf_dir):
    rows = queries.f18_changed_ratio(spark, sf_dir).collect()
    assert {r.has for r in rows} <= {0, 1}
    assert all(r.has == (r.changed_ratio > 0) for r in rows)
    assert "count(m.n) AS has" in queries.ORACLES["f18_changed_ratio"]
