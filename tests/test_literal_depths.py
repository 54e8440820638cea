"""Literal windows at all depths."""

from pathlib import Path

import pytest

from verdigris.plans import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_all_depths_have_literal_windows(spark):
    rows = queries.QUERIES["window_literal_depths"](spark, str(DATA)).groupBy("depth").count().collect()
    assert sorted(r.depth for r in rows) == list(range(9))
