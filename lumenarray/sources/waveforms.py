"""Waveforms as cells and chunks.

Cells hold (arr, ch, i, a), one row a sample; chunks hold (arr, ch, i0,
samples), one row for each stretch of a channel. Chunks start at multiples of
their size and spread over the cluster by channel and time, so that no task
holds a channel or an array as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenarray.operators.ordered import previous_in_order

BIN_S = 21_600
CHUNK = 512
STRETCH = 4_096  # samples of a channel that a window is run over


def grid_chunks(events: DataFrame, channels: int = 15, bin_s: int = BIN_S, size: int = CHUNK) -> DataFrame:
    """Chunks from point events: a user is a channel, `channels` users an array,
    values summed in whole cents per time bin, silent bins filled with 0, from
    the first to the last bin in which any user has an event."""
    d = events.filter("user_id is not null and ts is not null").select("user_id", "value", F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / bin_s).alias("bin"))
    low, high = d.agg(F.min("bin"), F.max("bin")).first()
    low, last = low or 0, (high or 0) - (low or 0)
    sums = d.groupBy("user_id", (F.col("bin") - low).cast("int").alias("i")).agg(F.coalesce(F.sum(F.round(F.col("value") * 100).cast("bigint")), F.lit(0)).alias("v"))
    filled = sums.groupBy("user_id", F.floor(F.col("i") / size).cast("int").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    frame = d.select("user_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(last // size))))
    i0 = F.col("k") * size
    samples = F.transform(F.sequence(i0, F.least(i0 + size - 1, F.lit(last))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("bigint"))
    return frame.join(filled, ["user_id", "k"], "left").select(F.expr(f"user_id div {channels}").alias("arr"), (F.col("user_id") % channels).cast("int").alias("ch"), i0.alias("i0"), samples.alias("samples"))


def cells_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("arr", "ch", "i0", F.posexplode("samples").alias("_p", "a")).select("arr", "ch", (F.col("i0") + F.col("_p")).alias("i"), "a")


def grid(events: DataFrame, channels: int = 15, bin_s: int = BIN_S) -> DataFrame:
    return cells_of(grid_chunks(events, channels, bin_s))


def chunked(cells: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks of cells; samples that are missing within a chunk are 0."""
    i0 = F.floor(F.col("i") / size) * size
    packed = cells.filter("i is not null").groupBy("arr", "ch", i0.cast("int").alias("i0")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") % size).cast("int").alias("p"), F.coalesce("a", F.lit(0)).alias("a")))).alias("m"), F.max(F.col("i") % size).cast("int").alias("last"))
    return packed.select("arr", "ch", "i0", F.transform(F.sequence(F.lit(0), F.col("last")), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0))).alias("samples"))


def as_chunks(waves: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks whichever form the waves have."""
    return waves if "samples" in waves.columns else chunked(waves, size)


def traces(cells: DataFrame) -> DataFrame:
    """Trace form: one row per channel with its samples in order."""
    packed = F.sort_array(F.collect_list(F.struct("i", "a")))
    return cells.groupBy("arr", "ch").agg(F.transform(packed, lambda x: x["a"]).alias("samples"))


def haloed(cells: DataFrame, before: int, after: int, stretch: int = STRETCH) -> DataFrame:
    """Cells in stretches of time that overlap: `_s` numbers the stretch, `_own`
    marks the cells that are its own; `before` and `after` more lie round them."""
    part = lambda c: F.floor(c / stretch)
    d = cells.withColumn("_s", F.explode(F.sequence(F.greatest(part(F.col("i") - after), F.lit(0)), part(F.col("i") + before))))
    return d.withColumn("_own", F.col("_s") == part(F.col("i")))


def by_stretch():
    """Samples of a channel's stretch in order."""
    return Window.partitionBy("arr", "ch", "_s").orderBy("i")


def oriented(cells: DataFrame, mode: str = "auto") -> DataFrame:
    """Swap channels and samples: always (tc), never (ct) or where an array has
    more channels than samples (auto)."""
    if mode == "ct":
        return cells
    swap = F.lit(True)
    d = cells
    if mode == "auto":
        sizes = cells.groupBy("arr").agg((F.max("ch") > F.max("i")).alias("_swap"))
        d, swap = cells.join(sizes, "arr"), F.col("_swap")
    return d.select("arr", F.when(swap, F.col("i")).otherwise(F.col("ch")).alias("ch"), F.when(swap, F.col("ch")).otherwise(F.col("i")).alias("i"), "a")


def cropped(cells: DataFrame, ch_from: int | None = None, ch_to: int | None = None, i_from: int | None = None, i_to: int | None = None) -> DataFrame:
    """Channels ch_from..ch_to (inclusive), samples i_from..i_to-1; filters that
    reach the scan."""
    for col, low, high in (("ch", ch_from, None if ch_to is None else ch_to + 1), ("i", i_from, i_to)):
        cells = cells if low is None else cells.filter(F.col(col) >= low)
        cells = cells if high is None else cells.filter(F.col(col) < high)
    return cells


def derivative(cells: DataFrame, fs: float = 1.0) -> DataFrame:
    """(a[i+1] - a[i]) * fs; the last sample of a channel has none."""
    d = previous_in_order(cells, ["arr", "ch"], ["i"], F.floor(F.col("i") / STRETCH), ["i", "a"])
    return d.filter("prev is not null").select("arr", "ch", "prev.i", ((F.col("a") - F.col("prev.a")) * fs).alias("a"))


def common_mode_removed(cells: DataFrame) -> DataFrame:
    """Each sample less the median over the array's channels at its time."""
    middle = cells.groupBy("arr", "i").agg(F.median("a").alias("_m"))
    return cells.join(middle, ["arr", "i"]).select("arr", "ch", "i", (F.col("a") - F.col("_m")).alias("a"))


def finite(x: Column) -> Column:
    """x as a number, null where it is none or not finite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def sanitized(cells: DataFrame) -> DataFrame:
    """Non-finite and null samples become 0."""
    return cells.withColumn("a", F.coalesce(finite(F.col("a")), F.lit(0.0)))


def dead_channels(cells: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Channels whose variance is below floor * max(1, the array's median variance)."""
    v = sanitized(cells).groupBy("arr", "ch").agg(F.var_pop("a").alias("variance"))
    m = v.groupBy("arr").agg(F.greatest(F.lit(1.0), F.median("variance")).alias("_m"))
    return v.join(m, "arr").filter(F.col("variance") < floor * F.col("_m")).select("arr", "ch", "variance")


def concatenated(cells: DataFrame, file: str = "file") -> DataFrame:
    """Files of an array joined end to end in order of their name.

    Cells carry `file`; i restarts in each. Only the files' lengths are summed
    up by array. Where cells carry `fs`, an array whose files differ in it
    gives an error, as samples of different length can't be joined.
    """
    rates = [F.count_distinct("fs").alias("_rates")] if "fs" in cells.columns else []
    lengths = cells.groupBy("arr", file).agg((F.max("i") + 1).alias("_len"))
    if rates:
        odd = cells.groupBy("arr").agg(*rates).withColumn("_one", F.when(F.col("_rates") <= 1, F.lit(0)).otherwise(F.raise_error(F.lit("files of one array differ in sampling rate")).cast("int")))
        lengths = lengths.join(odd.select("arr", "_one"), "arr").withColumn("_len", F.col("_len") + F.col("_one")).drop("_one")
    up = Window.partitionBy("arr").orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offset = lengths.select("arr", file, F.coalesce(F.sum("_len").over(up), F.lit(0)).alias("_off"))
    return cells.join(offset, ["arr", file]).select("arr", "ch", (F.col("i") + F.col("_off")).alias("i"), "a")


def within(points: DataFrame, spans: DataFrame, low: Column, high: Column, at: str = "i", width: int = 64) -> DataFrame:
    """Points joined with the spans of their array that hold them (low..high,
    both inclusive): a span goes to each stretch of time that it touches, a
    point to one, so an array never meets all of its spans."""
    part = lambda c: F.floor(c / width)
    s = spans.withColumn("_low", low).withColumn("_high", high).withColumn("_w", F.explode(F.sequence(part(F.col("_low")), part(F.col("_high")))))
    return points.withColumn("_w", part(F.col(at))).join(s, ["arr", "_w"]).filter(F.col(at).between(F.col("_low"), F.col("_high"))).drop("_w", "_low", "_high")


def stretches(chunks: DataFrame, spans: DataFrame, low: Column, high: Column, size: int = CHUNK) -> DataFrame:
    """Chunks joined with the spans of their array that they overlap (low..high
    in samples); `size` is the chunks' size."""
    part = lambda c: F.floor(c / size)
    s = spans.withColumn("_w", F.explode(F.sequence(part(F.greatest(low, F.lit(0))), part(F.greatest(high, F.lit(0))))))
    return chunks.withColumn("_w", part(F.col("i0"))).join(s, ["arr", "_w"]).drop("_w")


def quiet_stretches(spans: DataFrame, margin: float = 5.0, least: float = 10.0) -> DataFrame:
    """Stretches of (file, length_s, origin_s) that lie farther than margin from
    the origin and last at least `least`; the whole file if there is none."""
    both = F.when(F.col("origin_s").isNull(), F.array(F.struct(F.lit(0.0).alias("from_s"), F.col("length_s").alias("to_s")))).otherwise(
        F.array(F.struct(F.lit(0.0).alias("from_s"), F.least(F.col("origin_s") - margin, "length_s").alias("to_s")), F.struct(F.greatest(F.col("origin_s") + margin, F.lit(0.0)).alias("from_s"), F.col("length_s").alias("to_s")))
    )
    return spans.select("file", F.explode(both).alias("s")).select("file", "s.*").filter(F.col("to_s") - F.col("from_s") >= least)
