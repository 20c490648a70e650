from pathlib import Path

from pyspark.sql import functions as F

from heliotable.plans.durable import cut, ensure_checkpoint_dir
from heliotable.plans.joins import sized, spread
from heliotable.plans.shipping import ship
from heliotable.plans.tables import in_parallel


def test_lineage_is_cut_into_the_shared_folder(spark):
    folder = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == folder
    df = cut(spark.range(10).withColumn("x", F.rand()))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.collect()))
    assert any(Path(folder.removeprefix("file:")).rglob("part-*"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_growing_sides_are_shuffled(spark):
    left, right = spark.range(1000).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" not in plan(left.join(spread(right), "k"))
    assert "BroadcastHashJoin" in plan(left.join(sized(right, 10), "k"))
    assert "BroadcastHashJoin" not in plan(left.join(sized(right, 10, most=9), "k"))


def test_few_partitions_are_spread(spark):
    assert in_parallel(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(9)
    assert in_parallel(many) is many


def test_shipping_twice_is_harmless(spark):
    ship(spark)
    ship(spark)
