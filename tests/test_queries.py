"""Every query of the comparison engine against its SQL, and those without SQL by their properties."""

import pytest
from compare import DATA, same

from deltaspan.plans import registry


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    same(registry.QUERIES[name](spark, str(DATA)), registry.ORACLES[name])


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_entry(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 5


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_pooled_bootstrap_is_stable(spark):
    a, b = (registry.QUERIES["bootstrap_pooled"](spark, str(DATA)).first() for _ in range(2))
    assert a == b and a["min"] <= a["p2_5"] <= a["p50"] <= a["p97_5"] <= a["max"]
