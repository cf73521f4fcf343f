from revlytics.llm import common
from revlytics.llm.components import connected_components


def _collections(spark):
    """Whole collections of the driver's garbage so far."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_garbage_of_ended_rounds_is_collected_while_the_job_goes_on(spark, monkeypatch):
    edges = spark.range(8).selectExpr("id + 1 as u", "id as v")
    monkeypatch.setattr(common, "CLEAN_SECONDS", 0, raising=False)
    before = _collections(spark)
    roots = connected_components(edges)
    assert _collections(spark) - before >= 3  # a table is staged first, and two a round
    assert {r.root for r in roots.collect()} == {0}
    monkeypatch.setattr(common, "CLEAN_SECONDS", 3600, raising=False)
    before = _collections(spark)
    common.stage(edges, "t"), common.stage(edges, "t")
    assert _collections(spark) - before <= 1
