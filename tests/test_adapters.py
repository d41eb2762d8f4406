"""Domain tables over the smallest tables."""

from pyspark.sql import functions as F

from keyloom.sources import adapters as A

SF = "/root/testdata/sf0.001"


def test_findings_come_in_parts_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "ROWS", 200, raising=False)
    sizes = [r["count"] for r in A.findings(spark, SF).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == A.table(spark, SF, "lineitem").count()
    assert max(sizes) <= 2 * 200
