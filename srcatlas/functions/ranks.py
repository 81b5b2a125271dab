"""Numbers and sums in order within groups of any size: no group is gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import write_stage


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, value: Column | None = None) -> DataFrame:
    """``df`` with the number of each row (from 1) in the order of its group, or with the running sum of ``value``, as ``name``.

    Rows are range-partitioned by group and order, so a group with a third of all rows lies in as many partitions as its size asks for;
    each partition counts its own rows, and the counts of the partitions before it - one row a group and partition - are added.
    The order must be total for a result that is always the same.
    """
    one = F.lit(1).cast("long") if value is None else value
    rows = df.withColumn("_v", one).repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    # written, so that a partition's number stays what it was
    rows = write_stage(rows, "ranks")
    own = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("_part", *group).agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part") if group else Window.partitionBy(F.lit(0)).orderBy("_part")
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_part", *group)]
    joined = rows.alias("a").join(F.broadcast(sums).alias("b"), keys) if not group else rows.alias("a").join(sums.alias("b"), keys)
    out = joined.select("a.*", "b._before").withColumn(name, F.col("_before") + F.sum("_v").over(own))
    return out.drop("_v", "_part", "_before")
