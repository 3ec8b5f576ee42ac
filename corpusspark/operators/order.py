"""Places in an order, without bringing a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusspark.tables import written


def placed(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """rows with their place in the order within their group, from 0, and _n, the group's size.

    Rows are spread by ranges of group and order, so that a group which holds a third of all rows
    takes a third of the tasks. Each task numbers its own stretch; sums of the stretches' sizes, a
    table of one row for each task and group, give where it starts. Ties fall in any order.
    """
    key = [f"_k{i}" for i in range(len(by))]
    keyed = rows.select("*", *[F.col(c).alias(k) for c, k in zip(by, key, strict=True)])
    spread = written(keyed.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = F.row_number().over(Window.partitionBy("_part", *key).orderBy(*order)) - 1
    sizes = spread.groupBy("_part", *key).agg(F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*key)
    starts = sizes.select("_part", *key, F.coalesce(F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_size").over(group).alias("_n"))
    on = [F.col("r._part") == F.col("s._part"), *[F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]]
    found = spread.withColumn("_own", own).alias("r").join(starts.alias("s"), on)
    return found.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("_own") + F.col("_start")).alias(name), "_n")
