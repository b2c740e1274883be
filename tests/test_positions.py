from pyspark.sql import Window
from pyspark.sql import functions as F

from demandspark.operators import positions


def test_ranged_positions_equal_a_plain_window(spark):
    frame = spark.range(5000).select(
        (F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 101).alias("v"), F.col("id")
    ).filter("k < 2 OR id = 2")
    order = [F.desc("v"), F.col("id")]
    group = Window.partitionBy("k")
    plain = frame.select("*", F.row_number().over(group.orderBy(*order)), F.count("*").over(group))
    plain = {tuple(r) for r in plain.collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = positions.numbered(frame, ["k"], order).select("k", "v", "id", "position", "n_rows")
        assert {tuple(r) for r in ranged.collect()} == plain
        assert len(plain) == frame.count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
