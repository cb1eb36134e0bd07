"""Problem 1: history of changing entity attributes.

Every source is turned into statements (entity, time, rank, attribute, value).
Each attribute gets a change log of its own; the logs are combined by
splitting at the union of their boundary dates and coalescing equal
neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenarray.operators.ordered import previous_in_order
from lumenarray.session import cut

BUCKET_S = 30 * 86400


def canonical_json(text: Column) -> Column:
    """The parsed value written one way: key order, spacing and 4 against 4.0
    don't matter. Null where the text is null or can't be parsed."""
    return F.to_json(F.try_parse_json(text))


def change_log(statements: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """Per-attribute change log of (entity, attribute, at, closing, value).

    A statement with `closing` says that the value held until `at` (a copy
    made before the next write); one without says that it held from `at` on.
    A change is dated by the closing statement just before it, if there is
    one, else by the first statement of the new value. Output: entity,
    attribute, valid_from, value; one row per change, the first included.
    At equal times closing statements come first.
    """
    s = statements.filter("entity is not null and at is not null").select("entity", "attribute", "at", (~F.col("closing")).cast("int").alias("opens"), "value").distinct()
    s = s.withColumn("_v", F.coalesce("value", F.lit("")))
    p = previous_in_order(s, ["entity", "attribute"], ["at", "opens", "_v"], F.floor(F.col("at") / bucket_s), ["at", "opens", "value"])
    changed = F.col("prev").isNull() | ~F.col("prev.value").eqNullSafe(F.col("value"))
    dated = F.when(F.col("prev.opens") == 0, F.col("prev.at")).otherwise(F.col("at"))
    return p.filter(changed).select("entity", "attribute", dated.alias("valid_from"), "at", "value")


def combine(log: DataFrame, attributes: list[str], bucket_s: int = BUCKET_S) -> DataFrame:
    """Versions of the whole entity from the logs of its attributes.

    Splits at the union of the boundary dates, takes each attribute's value
    as of each date and coalesces neighbours that are alike. Output: entity,
    valid_from, valid_to (null for the present version), one column per
    attribute. Like the logs themselves, dates are put in order within time
    buckets; only each bucket's last values are carried over, so an entity that
    changes with most rows isn't gathered in one task.
    """
    at = _as_of_dates(log, attributes).withColumn("_bucket", F.floor(F.col("valid_from") / bucket_s))
    within = Window.partitionBy("entity", "_bucket").orderBy("valid_from")
    ends = at.groupBy("entity", "_bucket").agg(*(F.max_by(a, F.when(F.col(a).isNotNull(), F.col("valid_from"))).alias(a) for a in attributes))
    before = Window.partitionBy("entity").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("entity", "_bucket", *(F.last(a, ignorenulls=True).over(before).alias(f"_{a}") for a in attributes))
    d = at.select("entity", "_bucket", "valid_from", *(F.last(a, ignorenulls=True).over(within).alias(a) for a in attributes)).join(carried, ["entity", "_bucket"])
    filled = d.select("entity", "valid_from", *(F.coalesce(a, f"_{a}").getField("value").alias(a) for a in attributes))
    state = F.struct(*attributes)
    p = previous_in_order(filled, ["entity"], ["valid_from"], F.floor(F.col("valid_from") / bucket_s), attributes)
    kept = cut(p.filter(F.col("prev").isNull() | ~F.col("prev").eqNullSafe(state)).select("entity", "valid_from", *attributes))
    # the next version is the one before in reverse order
    back = kept.withColumn("_back", -F.col("valid_from"))
    n = previous_in_order(back, ["entity"], ["_back"], F.floor(F.col("_back") / bucket_s), ["valid_from"])
    return n.select("entity", "valid_from", F.col("prev.valid_from").alias("valid_to"), *attributes)


def _as_of_dates(log: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per entity and boundary date; a struct per attribute changed there."""
    last = F.struct("at", F.coalesce("value", F.lit("")))
    per = [F.max_by(F.when(F.col("attribute") == a, F.struct("value")), F.when(F.col("attribute") == a, last)).alias(a) for a in attributes]
    return log.groupBy("entity", "valid_from").agg(*per)


def profile_statements(profiles: DataFrame, history: DataFrame) -> DataFrame:
    """Statements of thresholds and SNR50 from snapshots and history copies.

    Snapshots speak of the time of their last write (`updated`), not of the
    time they were taken. Failed exports (both attributes null) and rows
    whose thresholds can't be parsed say nothing.
    """
    def of(df: DataFrame, at: str, closing: bool) -> DataFrame:
        d = df.filter("thresholds_json is not null or snr50 is not null").select(
            F.col("array_id").alias("entity"), F.col(at).alias("at"), F.lit(closing).alias("closing"),
            canonical_json(F.col("thresholds_json")).alias("thresholds"), F.col("snr50").cast("string").alias("snr50"),
            F.col("thresholds_json").isNotNull().alias("_given"),
        )
        return d.filter("thresholds is not null or not _given").drop("_given")

    rows = of(profiles, "updated", False).unionByName(of(history, "archived_at", True)).distinct()
    return rows.selectExpr("entity", "at", "closing", "stack(2, 'thresholds', thresholds, 'snr50', snr50) as (attribute, value)")


def profile_versions(profiles: DataFrame, history: DataFrame) -> DataFrame:
    """Every version of an array's thresholds and SNR50 with its period.

    Output: array_id, valid_from, valid_to, thresholds, snr50 (text forms).
    Empty inputs give no versions.
    """
    log = cut(change_log(profile_statements(profiles, history)))  # one row a change, read by several steps
    return combine(log, ["thresholds", "snr50"]).withColumnRenamed("entity", "array_id")
