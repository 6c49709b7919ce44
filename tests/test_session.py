from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.session import settle


def test_a_table_small_on_disk_but_not_in_memory_is_not_broadcast(spark):
    """Its repeated name takes no room in the file and 80 MB in the driver."""
    name = F.repeat(F.lit("a long name "), 20)
    right = settle(spark.range(200_000).select("id", name.alias("name")), "names")
    left = settle(spark.range(200_000), "ids")
    joined = left.join(right, "id").select(F.sum(F.length("name")).alias("n"))
    assert joined.first()["n"] == 200_000 * 240
    joined.collect()
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_small_sides_of_a_loop_do_not_pass_the_driver(spark):
    """The new rows of a round are few; sent through the driver they add up over the rounds."""
    front = settle(spark.range(100), "front")
    joined = settle(spark.range(50_000), "edges").join(front, "id").groupBy("id").count()
    assert len(joined.collect()) == 100
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
