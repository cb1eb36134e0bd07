"""Problem 6: pairing records by nearest time, as a stateful streaming join.

Both sides are streams with watermarks. The join buffers them per entity, a
left row's nearest candidate is emitted once the watermark has passed its
tolerance horizon, and candidates that no left row can reach are evicted.
The same plan serves live streams and finite tables; a finite table is fed in
time slices, so that the state never holds more than about one slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarray.functions.files import absolute_ms, current, file_start_s, with_array
from lumenarray.session import scratch

TOLERANCE_MS = 20_000
DAY_MS = 86_400_000
SLICE_ROWS_PER_CORE = 150_000  # in the state at a time, for each core of the cluster
LEFT = "entity string, left_id string, t_ms bigint"
RIGHT = "entity string, right_id string, t_ms bigint"


def nearest_stream(left: DataFrame, right: DataFrame, tolerance_ms: int) -> DataFrame:
    """Streaming plan: for each left row the nearest right row of its entity.

    left (LEFT) and right (RIGHT) are streams. An entity is split into time
    buckets twice as wide as the tolerance, so that one that owns a large
    share of all rows spreads over the cluster; a left row goes to the at most
    two buckets that its tolerance reaches. Output in append mode: left_id,
    left_time, entity, bucket, nearest (gap_ms, right_id); ties take the least
    right_id. A left row at a bucket's edge gives a row for each bucket.
    """
    width = 2 * tolerance_ms
    delay = f"{tolerance_ms} milliseconds"
    low, high = (F.floor((F.col("t_ms") + x) / width) for x in (-tolerance_ms, tolerance_ms))
    a = left.select("entity", "left_id", F.col("t_ms").alias("left_ms"), F.timestamp_millis("t_ms").alias("left_time"), F.explode(F.array_distinct(F.array(low, high))).alias("bucket")).withWatermark("left_time", delay).alias("a")
    b = right.select("entity", "right_id", F.col("t_ms").alias("right_ms"), F.timestamp_millis("t_ms").alias("right_time"), F.floor(F.col("t_ms") / width).alias("bucket")).withWatermark("right_time", delay).alias("b")
    near = F.expr(f"a.entity = b.entity and a.bucket = b.bucket and b.right_time >= a.left_time - interval {tolerance_ms} milliseconds and b.right_time <= a.left_time + interval {tolerance_ms} milliseconds")
    pairs = a.join(b, near).select("a.entity", "a.bucket", "a.left_id", "a.left_time", F.struct(F.abs(F.col("left_ms") - F.col("right_ms")).alias("gap_ms"), F.col("right_id")).alias("candidate"))
    return pairs.groupBy("entity", "bucket", "left_id", "left_time").agg(F.min("candidate").alias("nearest"))


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_ms: int = TOLERANCE_MS, slice_rows: int | None = None) -> DataFrame:
    """nearest_stream over finite tables: entity, left_id, left_ms, right_id, gap_ms.

    Instants are staged in the shared folder: of an entity's right rows at one
    instant only the least right_id can answer, and its left rows at one
    instant have one answer, so an entity comes to 40,000 rows a bucket at
    most, however many its rows. If all fit the state, the staged files are the
    stream; else they are put in order of time once, and fed slice by slice,
    each as one micro-batch of the same streaming query, whose state and
    progress live in the shared folder too, so that it survives lost executors.
    slice_rows bounds the state; by default it follows the number of cores. A
    last mark beyond all times lets the watermark pass every horizon. Rows with
    a null entity, id or time take no part; left rows without a candidate give
    no row; repeated rows count once.
    """
    spark = left.sparkSession
    home = scratch(spark, "nearest")
    known = left.select("entity", "left_id", "t_ms").dropna()
    known.write.parquet(f"{home}/known")
    known = spark.read.schema(LEFT).parquet(f"{home}/known")
    instants = {
        "left": (known.select("entity", F.lit("").alias("left_id"), "t_ms").distinct(), LEFT),
        "right": (right.select("entity", "right_id", "t_ms").dropna().groupBy("entity", "t_ms").agg(F.min("right_id").alias("right_id")).select("entity", "right_id", "t_ms"), RIGHT),
    }
    end, total, days = 0, 0, {}
    for side, (df, schema) in instants.items():
        df.write.parquet(f"{home}/staged-{side}")
        # a row a day comes to the driver
        for r in spark.read.schema(schema).parquet(f"{home}/staged-{side}").groupBy(F.floor(F.col("t_ms") / DAY_MS).alias("day")).agg(F.count("*").alias("n"), F.max("t_ms").alias("last")).collect():
            days[r.day] = days.get(r.day, 0) + r.n
            end, total = max(end, r.last), total + r.n
    end += 10 * tolerance_ms
    slice_rows = slice_rows or SLICE_ROWS_PER_CORE * spark.sparkContext.defaultParallelism
    mark = lambda side: spark.createDataFrame([("", "", end)], instants[side][1]).coalesce(1)
    if total <= slice_rows:
        for side in instants:
            mark(side).write.mode("append").parquet(f"{home}/staged-{side}")
        _fed(spark, {side: f"{home}/staged-{side}" for side in instants}, home, tolerance_ms)
    else:
        parts = 4 * -(-total // slice_rows)
        for side, (_, schema) in instants.items():
            spark.read.schema(schema).parquet(f"{home}/staged-{side}").repartitionByRange(parts, "t_ms").sortWithinPartitions("t_ms").write.parquet(f"{home}/ordered-{side}")
        edges = _edges(days, slice_rows, {side: spark.read.schema(schema).parquet(f"{home}/ordered-{side}") for side, (_, schema) in instants.items()})
        for k, (a, z) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
            for side, (_, schema) in instants.items():
                # in order of time: a slice's filter leaves out all other row groups
                part = spark.read.schema(schema).parquet(f"{home}/ordered-{side}")
                part = part if a is None else part.filter(F.col("t_ms") >= a)
                part = part if z is None else part.filter(F.col("t_ms") < z)
                part = part.unionByName(mark(side)) if k == len(edges) else part
                part.write.mode("append").parquet(f"{home}/feed-{side}")
            _fed(spark, {side: f"{home}/feed-{side}" for side in instants}, home, tolerance_ms)
    # a left row at the edge of two buckets keeps the nearer of its candidates
    out = spark.read.schema("entity string, bucket bigint, left_id string, left_time timestamp, nearest struct<gap_ms: bigint, right_id: string>").parquet(f"{home}/out")
    best = out.filter("entity <> ''").groupBy("entity", F.unix_millis("left_time").alias("t_ms")).agg(F.min("nearest").alias("n"))
    return known.distinct().join(best, ["entity", "t_ms"]).select("entity", "left_id", F.col("t_ms").alias("left_ms"), "n.right_id", "n.gap_ms")


def _edges(days: dict[int, int], slice_rows: int, ordered: dict[str, DataFrame]) -> list[int]:
    """Times that part slices of about slice_rows rows: ends of days; within a
    day of more rows than that, quantiles of that day."""
    edges, held = [], 0
    for day in sorted(days):
        parts = -(-days[day] // slice_rows)
        if held and held + days[day] > slice_rows:
            edges.append(day * DAY_MS)
            held = 0
        if parts > 1:
            one = [df.filter(F.col("t_ms").between(day * DAY_MS, (day + 1) * DAY_MS - 1)).select("t_ms") for df in ordered.values()]
            edges += map(int, one[0].unionByName(one[1]).approxQuantile("t_ms", [k / parts for k in range(1, parts)], 0.1 / parts))
            held = slice_rows
        else:
            held += days[day]
    return sorted(set(edges))


def _fed(spark: SparkSession, paths: dict[str, str], home: str, tolerance_ms: int) -> None:
    """One run of the streaming query over what is new in its folders."""
    streams = [spark.readStream.schema(schema).parquet(paths[side]) for side, schema in (("left", LEFT), ("right", RIGHT))]
    query = (
        nearest_stream(*streams, tolerance_ms).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", f"{home}/out").option("checkpointLocation", f"{home}/progress").start()
    )
    query.awaitTermination()


def origins(ledger: DataFrame, arrays: DataFrame) -> DataFrame:
    """LEFT rows: the catalogued origins of current ledger rows."""
    from lumenarray.operators.nested import whole_json

    now = with_array(current(ledger, "gt_json").filter("gt_json is not null"), arrays)
    origin = F.get_json_object(whole_json(F.col("gt_json")), "$.origin_time")
    return now.select(F.col("array").alias("entity"), F.col("event_file").alias("left_id"), absolute_ms(origin).alias("t_ms")).filter("t_ms is not null")


def verdicts(resultados: DataFrame, arrays: DataFrame) -> DataFrame:
    """RIGHT rows: verdicts at the start of their file plus their offset; the
    id is file and event_id, parted by a line feed."""
    d = with_array(resultados.filter("file is not null and event_id is not null and time_offset_s is not null and not isnan(time_offset_s)").select("file", "event_id", "time_offset_s"), arrays, "file")
    at = F.round((file_start_s(F.col("file")) + F.col("time_offset_s")) * 1000).cast("bigint")
    return d.select(F.col("array").alias("entity"), F.concat_ws("\n", "file", "event_id").alias("right_id"), at.alias("t_ms")).filter("t_ms is not null")


def paired(spark: SparkSession, ledger: DataFrame, resultados: DataFrame, arrays: DataFrame) -> DataFrame:
    """Each origin with the nearest verdict of its array: event_file, file, event_id, gap_ms."""
    n = nearest_in_time(origins(ledger, arrays), verdicts(resultados, arrays))
    return n.select(F.col("left_id").alias("event_file"), F.split_part("right_id", F.lit("\n"), F.lit(1)).alias("file"), F.split_part("right_id", F.lit("\n"), F.lit(2)).alias("event_id"), "gap_ms")
