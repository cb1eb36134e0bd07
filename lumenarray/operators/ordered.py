"""Ordered look-back that holds when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def previous_in_order(df: DataFrame, keys: list[str], order: list[str], bucket: Column, cols: list[str], into: str = "prev") -> DataFrame:
    """Add struct column `into`: the values `cols` of the row before, by key.

    `bucket` is a monotone coarsening of the first order column. The window
    runs within (key, bucket), so no task holds a whole key; only the last row
    of each bucket is carried over to the next one. Null for a key's first
    row. Rows with a null key are dropped.
    """
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    d = df.dropna(subset=keys).withColumn("_bucket", bucket)
    d = d.withColumn(into, F.lag(F.struct(*cols)).over(within))
    ends = d.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_end"))
    carried = ends.select(*keys, "_bucket", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried"))
    return d.join(carried, [*keys, "_bucket"]).withColumn(into, F.coalesce(into, "_carried")).drop("_bucket", "_carried")


SLICE_S, HOT_ROWS = 6 * 3600, 50_000


def numbered(df: DataFrame, keys: list[str], at: str, order: list[str], into: str, slice_s: float = SLICE_S, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with `into`: each row's place (from 0) within its key, in `order`.

    Rows are ordered within (key, time slice) only; the slices' sizes are
    summed up to where each begins. A slice of more than hot_rows rows is cut
    360 times finer, so a key is gathered in one task only where that many
    rows fall into one minute. `at` is the first of `order`, in seconds.
    """
    d = df.withColumn("_slice", F.floor(F.col(at) / slice_s))
    hot = d.groupBy(*keys, "_slice").count().filter(F.col("count") > hot_rows).select(*keys, "_slice", F.lit(True).alias("_hot"))
    fine = F.when(F.col("_hot"), F.floor((F.col(at) - F.col("_slice") * slice_s) * 360 / slice_s)).otherwise(0)
    d = d.join(hot, [*keys, "_slice"], "left").withColumn("_fine", fine).drop("_hot")
    cell = [*keys, "_slice", "_fine"]
    before = lambda *by: Window.partitionBy(*by)
    up = (Window.unboundedPreceding, -1)
    sizes = d.groupBy(*cell).count()
    begins = sizes.withColumn("_begin", F.coalesce(F.sum("count").over(before(*keys).orderBy("_slice", "_fine").rowsBetween(*up)), F.lit(0))).drop("count")
    return d.withColumn("_n", F.row_number().over(before(*cell).orderBy(*order)) - 1).join(begins, cell).withColumn(into, F.col("_begin") + F.col("_n")).drop("_slice", "_fine", "_begin", "_n")
