"""Results do not depend on the number of shuffle partitions; ordered ones not even in their order."""

import pytest

from stratalog.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["findings_order", "stack_merge", "roll_over", "delta_verdict"])
def test_partitions(spark, name):
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = [tuple(r) for r in catalogue.QUERIES[name](spark, SF).collect()]
            seen.append(rows if name == "findings_order" else sorted(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and seen[0]


def test_package_is_shipped_once(spark, monkeypatch):
    from stratalog import shipping

    monkeypatch.setenv("PYTHONPATH", "")
    shipping.ship(spark)
    held = set(shipping._SHIPPED)
    shipping.ship(spark)
    assert held == shipping._SHIPPED and spark.sparkContext.applicationId in held
