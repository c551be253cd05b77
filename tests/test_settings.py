"""Thresholds, tools and what is left to do."""

import pytest

from plansift.operators import settings


def test_thresholds():
    t = settings.Thresholds().changed(region_probability=0.7)
    assert t.region_probability == 0.7 and settings.Thresholds().region_probability == 0.5
    with pytest.raises(KeyError):
        t.changed(nothing=1)
    with pytest.raises(ValueError):
        t.changed(heat_density=1.5)
    assert all(abs(sum(p.values()) - 1) < 1e-9 for p in settings.PRESETS.values())


def test_tools(spark, sf_dir):
    known = settings.tools()
    assert len(known) > 200 and all(t["description"] for t in known.values())
    assert settings.call(spark, "a30_category_counts", {"sf_dir": sf_dir}).count() == 7
    assert settings.call(spark, "t01_position_cells", {"sf_dir": sf_dir}, limit=5).count() == 5
    with pytest.raises(KeyError):
        settings.call(spark, "none", {"sf_dir": sf_dir})
    with pytest.raises(ValueError):
        settings.call(spark, "a30_category_counts", {})
