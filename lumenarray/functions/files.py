"""What the name of a recording says: its array's prefix and its start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three ways a recording's start is written in its name.
STARTS = r"\d{8}T\d{6}Z|\d{4}-\d{2}-\d{2}_\d{2}\.\d{2}\.\d{2}|\d{8,11}"
PREFIX = rf"^(.+?)[_-](?:{STARTS})\.h5$"
START = rf"(?:^|[_-])({STARTS})\.h5$"


def file_prefix(name: Column) -> Column:
    """The array prefix of a recording name; '' if the name has another form."""
    return F.regexp_extract(name, PREFIX, 1)


def file_start_s(name: Column) -> Column:
    """UTC start of a recording in epoch seconds; null if the name has none."""
    digits = F.regexp_replace(F.regexp_extract(name, START, 1), "[^0-9]", "")
    written = F.unix_seconds(F.try_to_timestamp(F.concat(digits, F.lit("Z")), F.lit("yyyyMMddHHmmssX")))
    return F.when(F.length(digits) == 14, written).otherwise(digits.try_cast("bigint"))


def with_array(df: DataFrame, arrays: DataFrame, name: str = "event_file") -> DataFrame:
    """df with the array (column array) that the prefix of `name` belongs to.

    Rows whose prefix no array has are dropped, as they have no source.
    """
    a = arrays.filter("file_prefix is not null").groupBy(F.col("file_prefix").alias("_prefix")).agg(F.min("array_id").alias("array"))
    return df.withColumn("_prefix", file_prefix(F.col(name))).join(a, "_prefix").drop("_prefix")


def current(ledger: DataFrame, *cols: str) -> DataFrame:
    """The row of each event_file with the greatest ts (nulls last).

    Rows alike in ts are told apart by their values, so that the result does
    not depend on row order. Rows without event_file are dropped.
    """
    rest = [F.col(c) for c in cols]
    return (
        ledger.filter("event_file is not null")
        .groupBy("event_file")
        .agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("ts", F.lit(float("-inf"))), *rest)).alias("_r"))
        .select("event_file", "_r.*")
    )


def absolute_ms(text: Column) -> Column:
    """Epoch milliseconds of an absolute time in any of the catalogue's forms
    (ISO with T or a blank, slashes, comma or point before the fraction, an
    offset, or epoch seconds); UTC unless it says otherwise; else null."""
    t = F.trim(text)
    iso = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "/", "-"), ",", "."), r"^(\d{4}-\d{2}-\d{2})\s+", "$1T")
    zoned = F.when(iso.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    stamp = F.try_to_timestamp(F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}T\d"), zoned))
    return F.coalesce(F.when(t.rlike(r"^-?\d+(\.\d+)?$"), F.round(t.try_cast("double") * 1000).cast("bigint")), F.unix_millis(stamp))
