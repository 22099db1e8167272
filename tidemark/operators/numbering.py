"""Row numbers over a total order without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import materialize


def number_rows(df: DataFrame, order: list[str | Column], name: str, first: int = 1) -> DataFrame:
    """Adds a dense row number in the given order: a range-partitioned sort, the sizes of its
    partitions, and numbers within each. Only partition sizes are gathered; their number is bounded."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "numbered")
    sizes = dealt.groupBy("_part").count()
    ahead = sizes.select(F.col("_part"), F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_rank", rank).join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + F.col("_rank") - 1 + first).drop("_part", "_rank", "_ahead")
