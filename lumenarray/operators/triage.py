"""Tier 0: short- against long-term energy, trigger raster, events."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenarray.operators.ordered import numbered, previous_in_order
from lumenarray.session import cut
from lumenarray.sources.waveforms import as_chunks, by_stretch, finite, haloed, within


@dataclass(frozen=True)
class Tier0:
    """Lengths in samples and channels. `warm` samples have no full frames."""

    sta: int = 3
    lta: int = 24
    gap: int = 2
    threshold: float = 4.0
    merge: int = 1
    least: int = 2
    split: int = 3
    longest: int = 12
    dense: int = 2

    @property
    def warm(self) -> int:
        return self.sta + self.lta + self.gap


def physical(fs: float, n_ch: int, threshold: float = 4.0) -> Tier0:
    """The triage of an array of n_ch channels sampled fs times a second. Fixed
    values: 0.4 against 8 s, 0.4 s apart; events of 0.3 s and more, gaps of 3 s
    and of 80 channels; blocks over 20 s are cut where fewer than 1 % of the
    channels (4 at least) fire."""
    sta = max(1, int(0.4 * fs))
    return Tier0(sta, max(sta + 1, int(8.0 * fs)), int(0.4 * fs), threshold, int(3.0 * fs), max(1, math.ceil(0.3 * fs)), 80, int(20.0 * fs), max(4, int(0.01 * n_ch)))


def trailing_mean(cells: DataFrame, width: int, into: str = "mean") -> DataFrame:
    """Mean of the last `width` samples (fewer at the start), by prefix sums
    within stretches of a channel: one running sum and a look-back each,
    whatever the width."""
    d = haloed(cells, width, 0).withColumn("_c", F.sum("a").over(by_stretch().rowsBetween(Window.unboundedPreceding, 0)))
    n = F.least(F.col("i") + 1, F.lit(width))
    return d.withColumn(into, (F.col("_c") - F.coalesce(F.lag("_c", width).over(by_stretch()), F.lit(0))) / n).filter("_own").drop("_c", "_s", "_own")


def energy_ratios(samples: np.ndarray, lead: np.ndarray, first: np.ndarray, scale: np.ndarray, cfg: Tier0) -> np.ndarray:
    """Ratios of rows of samples, each led by the cfg.warm samples before (0
    where there are none). first: place of each row's first sample in its
    channel; scale: the array's greatest size, 0 if it has no energy to speak of."""
    p = np.concatenate([lead, samples], axis=1).astype(np.float64)
    np.square(p, out=p)
    c = np.zeros((p.shape[0], p.shape[1] + 1))
    np.cumsum(p, axis=1, out=c[:, 1:])
    w, n = cfg.warm, samples.shape[1]
    at = lambda back: c[:, w + 1 - back : w + 1 - back + n]
    delay = cfg.sta + cfg.gap
    ratio = (at(0) - at(cfg.sta)) / cfg.sta
    long = (at(delay) - at(delay + cfg.lta)) / cfg.lta
    long += 1e-12 * (scale * scale)[:, None]  # as of samples brought to a greatest size of 1
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio /= long
    ratio[(first[:, None] + np.arange(n) < w) | (scale[:, None] == 0)] = 1.0
    return ratio


def sta_lta(waves: DataFrame, cfg: Tier0 = Tier0(), above: float | None = None) -> DataFrame:
    """arr, ch, i, ratio: short-term over delayed long-term mean energy; 1 while
    warming up, and throughout an array that is silent or holds a value that
    is not finite. Null samples are 0. waves: cells or chunks, whose size must
    be cfg.warm at least. above: only ratios above it.

    Chunks get the end of the one before as a lead-in; sums run within a
    chunk, in Arrow batches of many channels at once.
    """
    chunks = as_chunks(waves).select("arr", "ch", "i0", "samples")
    most, least = F.array_max("samples").cast("double"), F.array_min("samples").cast("double")  # nan counts as the greatest
    scale = chunks.groupBy("arr").agg(F.greatest(F.max(most), -F.min(least)).alias("scale")).select("arr", F.coalesce(finite(F.col("scale")), F.lit(0.0)).alias("scale"))
    tail = F.slice("samples", F.greatest(F.size("samples") - cfg.warm + 1, F.lit(1)), F.lit(cfg.warm))
    d = chunks.withColumn("_tail", tail).withColumn("_end", F.col("i0") + F.size("samples"))
    d = previous_in_order(d, ["arr", "ch"], ["i0"], F.floor(F.col("i0") / (1 << 20)), ["_tail", "_end"])
    lead = F.when(F.col("prev._end") == F.col("i0"), F.col("prev._tail"))
    d = d.select("arr", "ch", "i0", "samples", lead.alias("lead")).join(scale, "arr")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arr, ch, i0, scale = (b.column(c).to_numpy() for c in ("arr", "ch", "i0", "scale"))
            values, offsets = b.column("samples").values.to_numpy(zero_copy_only=False), b.column("samples").offsets.to_numpy()
            length = np.diff(offsets)
            leads = np.zeros((len(arr), cfg.warm))
            led, held = b.column("lead").offsets.to_numpy(), b.column("lead").values.to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(np.diff(led)).tolist():
                leads[k, cfg.warm - (led[k + 1] - led[k]) :] = np.nan_to_num(held[led[k] : led[k + 1]])
            for n in np.unique(length).tolist():
                for rows in np.array_split(np.flatnonzero(length == n), max(1, int((length == n).sum()) * max(n, 1) // 1_000_000)):
                    if not n or not len(rows):
                        continue
                    x = values[offsets[rows][:, None] + np.arange(n)]
                    ratio = energy_ratios(np.nan_to_num(x), leads[rows], i0[rows], scale[rows], cfg)
                    r, i = np.nonzero(ratio > above) if above is not None else (k.ravel() for k in np.indices(ratio.shape))
                    yield pa.RecordBatch.from_arrays([pa.array(arr[rows][r]), pa.array(ch[rows][r]), pa.array((i0[rows][r] + i).astype(np.int32)), pa.array(ratio[r, i])], ["arr", "ch", "i", "ratio"])

    return d.select("arr", "ch", "i0", "scale", "lead", "samples").mapInArrow(run, "arr bigint, ch int, i int, ratio double")


def raster(ratio: DataFrame, cfg: Tier0 = Tier0()) -> DataFrame:
    """The firing cells only."""
    return ratio.filter(F.col("ratio") > cfg.threshold)


def islands(points: DataFrame, keys: list[str], merge: int, into: str = "run", width: int = 1 << 16) -> DataFrame:
    """Runs of `i` by key, a new one where more than `merge` are missing, named
    by where they begin. Ordered within stretches of time; a run that goes on
    in the next is carried over."""
    d = previous_in_order(points, keys, ["i"], F.floor(F.col("i") / width), ["i"])
    new = F.col("prev").isNull() | (F.col("i") - F.col("prev.i") - 1 > merge)
    d = d.withColumn("_from", F.when(new, F.col("i"))).withColumn("_k", F.floor(F.col("i") / width)).drop("prev")
    last = d.groupBy(*keys, "_k").agg(F.max("_from").alias("_last"))
    up = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_k", F.last("_last", ignorenulls=True).over(up).alias("_carried"))
    here = F.last("_from", ignorenulls=True).over(Window.partitionBy(*keys, "_k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_here", here).join(carried, [*keys, "_k"]).withColumn(into, F.coalesce("_here", "_carried")).drop("_from", "_k", "_here", "_carried")


def merge_runs(fired: DataFrame, cfg: Tier0 = Tier0()) -> DataFrame:
    """arr, run, i_from, i_to: runs in which any channel fires. Channels are
    reduced to distinct times before the array's times are put in order."""
    times = fired.select("arr", "i").distinct()
    return islands(times, ["arr"], cfg.merge).groupBy("arr", "run").agg(F.min("i").alias("i_from"), F.max("i").alias("i_to"))


def resegmented(fired: DataFrame, cfg: Tier0 = Tier0()) -> DataFrame:
    """merge_runs with over-long runs cut to their stretches of dense firing; a
    run without any stays whole. arr, i_from, i_to, numbered (seg) in order."""
    runs = cut(merge_runs(fired, cfg))  # few; the steps below read them several times
    long = F.col("i_to") - F.col("i_from") + 1 > cfg.longest
    times = fired.groupBy("arr", "i").agg(F.count_distinct("ch").alias("n")).filter(F.col("n") >= cfg.dense)
    inside = within(times, runs.filter(long), F.col("i_from"), F.col("i_to")).select("arr", "run", "i")
    dense = cut(islands(inside, ["arr", "run"], cfg.merge, "part").groupBy("arr", "run", "part").agg(F.min("i").alias("i_from"), F.max("i").alias("i_to")))
    kept = runs.filter(~long).unionByName(runs.filter(long).join(dense.select("arr", "run").distinct(), ["arr", "run"], "left_anti"))
    out = cut(kept.select("arr", "i_from", "i_to").unionByName(dense.select("arr", "i_from", "i_to")))
    return numbered(out, ["arr"], "i_from", ["i_from"], "seg", slice_s=1 << 20).withColumn("seg", F.col("seg").cast("int"))


def extract_events(fired: DataFrame, cfg: Tier0 = Tier0()) -> DataFrame:
    """Events: runs long enough, split where channels lie apart, tightened to
    their own firing, long enough again.

    arr, event_id, i_from, i_to, ch_min, ch_max, n_ch, peak. Ordinals in
    event_id count dropped segments and groups too. fired should be a stored
    table (or cut), as several branches read it.
    """
    seg = resegmented(fired, cfg).filter(F.col("i_to") - F.col("i_from") + 1 >= cfg.least)
    cell = within(fired, seg, F.col("i_from"), F.col("i_to")).select("arr", "seg", F.col("i_from").alias("seg_from"), "ch", "i", "ratio")
    per = cell.groupBy("arr", "seg", "seg_from", "ch").agg(F.min("i").alias("i_from"), F.max("i").alias("i_to"), F.max("ratio").alias("peak"))
    order = Window.partitionBy("arr", "seg").orderBy("ch")
    apart = F.coalesce((F.col("ch") - F.lag("ch").over(order) > cfg.split).cast("int"), F.lit(0))
    groups = per.withColumn("_n", apart).withColumn("grp", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).withColumn("n_grp", F.sum("_n").over(Window.partitionBy("arr", "seg")) + 1)
    ev = groups.groupBy("arr", "seg", "seg_from", "grp", "n_grp").agg(
        F.min("i_from").alias("i_from"), F.max("i_to").alias("i_to"), F.min("ch").alias("ch_min"), F.max("ch").alias("ch_max"), F.count("*").alias("n_ch"), F.max("peak").alias("peak")
    ).filter(F.col("i_to") - F.col("i_from") + 1 >= cfg.least)
    name = F.concat(F.format_string("evt_%04d_%d", "seg", "seg_from"), F.when(F.col("n_grp") > 1, F.format_string("_%d", "grp")).otherwise(""))
    return ev.select("arr", name.alias("event_id"), "i_from", "i_to", "ch_min", "ch_max", "n_ch", "peak")


def reduction(ratio: DataFrame, cfg: Tier0 = Tier0()) -> DataFrame:
    """Shares of firing cells and times, and of silent time, by array."""
    fired = F.col("ratio") > cfg.threshold
    per = ratio.groupBy("arr", "i").agg(F.count("*").alias("n"), F.sum(fired.cast("int")).alias("f"))
    s = per.groupBy("arr").agg((F.sum("f") / F.sum("n")).alias("flagged_cells"), (F.sum((F.col("f") > 0).cast("int")) / F.count("*")).alias("flagged_time"))
    return s.withColumn("silence", 1 - F.col("flagged_time"))
