"""Cross-correlation of channels with a virtual source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenarray.functions.signal import envelope, over_traces, whitened
from lumenarray.sources.waveforms import by_stretch, haloed, within


def boxcar(cells: DataFrame, width: int) -> DataFrame:
    """Centred mean of `width` samples; beyond the ends the signal is 0."""
    before = (width - 1) // 2
    after = width - 1 - before
    d = haloed(cells, before, after).withColumn("_m", F.sum("a").over(by_stretch().rowsBetween(-before, after)) / width)
    return d.filter("_own").select("arr", "ch", "i", F.col("_m").alias("a"))


def windows(cells: DataFrame, window: int, hop: int) -> DataFrame:
    """Cells with the number (win) of each hopping window that holds them;
    windows start at 0, hop, ... and lie wholly within the array's samples."""
    n = cells.groupBy("arr").agg((F.max("i") + 1).alias("_n"))
    last = F.floor((F.col("_n") - window) / hop)
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - window + 1) / hop))
    high = F.least(F.floor(F.col("i") / hop), last)
    return cells.join(n, "arr").filter(low <= high).select("arr", "ch", "i", "a", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("win"))


def correlated(y: np.ndarray, r: np.ndarray, lags: int) -> np.ndarray:
    """Sum over i of r[i] * y[i + lag] for lag -lags..lags, row by row, by Fourier transforms."""
    n = 1 << (y.shape[1] + lags - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(y, n, axis=1) * np.conj(np.fft.rfft(r, n, axis=1)), n, axis=1)
    return np.concatenate([c[:, n - lags :], c[:, : lags + 1]], axis=1)


def gather(cells: DataFrame, ref: int, lags: int, window: int, hop: int, whiten: tuple[float, float, float] | None = None) -> DataFrame:
    """arr, ch, lag, ncf: one-bit cross-correlation of each channel with channel
    `ref` (or, with a column ref, that of its array), averaged over hopping
    windows. whiten: (fs, low, high) of a spectral whitening of the one-bit
    windows. The reference's window is one array on each row, so a pair of channels
    meets by one join on (arr, win); many pairs go through one transform."""
    w = windows(cells, window, hop)
    packed = w.groupBy("arr", "win", "ch").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.col("a").cast("double").alias("a")))), lambda x: x["a"]).alias("y"))
    refs = cells.select("arr", F.col("ref").alias("ch")).distinct() if "ref" in cells.columns else cells.select("arr").distinct().withColumn("ch", F.lit(ref))
    r = packed.join(refs, ["arr", "ch"]).select("arr", "win", F.col("y").alias("r"))

    def bits(x: np.ndarray) -> np.ndarray:
        b = whitened(np.sign(x), *whiten) if whiten else np.sign(x)
        b = b - b.mean(axis=1, keepdims=True)
        return b / (np.linalg.norm(b, axis=1, keepdims=True) + 1e-12)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 1_000):
                part = b.iloc[a : a + 1_000]
                c = correlated(bits(np.stack(part["y"].to_numpy())), bits(np.stack(part["r"].to_numpy())), lags)
                yield pd.DataFrame({"arr": part["arr"], "ch": part["ch"], "win": part["win"], "c": list(c)})

    n = packed.groupBy("arr").agg(F.count_distinct("win").alias("n"))
    d = packed.join(r, ["arr", "win"]).mapInPandas(run, "arr bigint, ch int, win int, c array<double>")
    d = d.select("arr", "ch", F.posexplode("c").alias("lag", "d")).groupBy("arr", "ch", (F.col("lag") - lags).alias("lag")).agg(F.sum("d").alias("d"))
    return d.join(n, "arr").select("arr", "ch", "lag", (F.col("d") / F.col("n")).alias("ncf"))


def gather_of_events(events: DataFrame, cells: DataFrame, lags: int, window: int, hop: int, pad: int, offset: int = 0, whiten: tuple[float, float, float] | None = None) -> DataFrame:
    """arr, event_id, ch, lag, ncf: a gather of each event (a tracked source),
    over its time and `pad` samples round it, all channels of the array against
    the event's middle channel (plus offset, within the array's channels)."""
    last = cells.groupBy("arr").agg(F.max("ch").alias("_top"))
    middle = F.least(F.greatest(F.floor((F.col("ch_min") + F.col("ch_max")) / 2).cast("int") + offset, F.lit(0)), F.col("_top"))
    e = events.join(last, "arr").select("arr", "event_id", "i_from", "i_to", middle.alias("ref"))
    numbers = e.withColumn("_id", F.xxhash64("arr", "event_id"))
    cut_ = within(cells, numbers, F.greatest(F.col("i_from") - pad, F.lit(0)), F.col("i_to") + pad)
    start = F.greatest(F.col("i_from") - pad, F.lit(0))
    g = gather(cut_.select(F.col("_id").alias("arr"), "ch", (F.col("i") - start).cast("int").alias("i"), "a", "ref"), 0, lags, window, hop, whiten)
    return g.join(numbers.select(F.col("_id"), F.col("arr").alias("_arr"), "event_id"), F.col("arr") == F.col("_id")).select(F.col("_arr").alias("arr"), "event_id", "ch", "lag", "ncf")


def folded(g: DataFrame) -> DataFrame:
    """arr, ch, lag (from 0), f: the half sum of both sides of a gather."""
    return g.groupBy("arr", "ch", F.abs("lag").alias("lag")).agg(F.avg("ncf").alias("f"))


def group_velocity(g: DataFrame, ref: int, v_min: float = 0.5, v_max: float = 4.0, least_offset: int = 1, most_offset: int = 7, least_channels: int = 8) -> DataFrame:
    """arr, velocity (channels a sample), r2: a line through the origin, offset
    = velocity * time, weighted by amplitude; times are those of each channel's
    greatest envelope between offset / v_max and offset / v_min, r2 is that of
    the times. Channels whose stretch has under three lags are left out, as
    are arrays with fewer channels than least_channels or no time above 0."""
    f = folded(g)
    traces = f.groupBy("arr", "ch").agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "f"))), lambda x: x["f"]).alias("samples"))
    env = over_traces(traces, envelope).select("arr", "ch", F.posexplode("samples").alias("t", "e"), (F.size("samples") - 1).alias("_last")).withColumn("w", F.round("e", 9)).withColumn("o", F.abs(F.col("ch") - ref)).filter(f"o between {least_offset} and {most_offset}")
    low, high = F.greatest(F.lit(0), F.floor(F.col("o") / v_max)), F.least(F.col("_last"), F.ceil(F.col("o") / v_min))
    best = env.filter((high - low >= 2) & F.col("t").between(low, high)).groupBy("arr", "ch", "o").agg(F.max_by(F.struct("t", "w"), F.struct("w", -F.col("t"))).alias("b"))
    p = best.select("arr", "o", "b.t", "b.w")
    fit = p.groupBy("arr").agg(F.count("*").alias("n"), F.max("t").alias("top"), (F.sum(F.expr("w * o * t")) / (F.sum(F.expr("w * t * t")) + 1e-12)).alias("velocity"), (F.sum(F.expr("w * t")) / F.sum("w")).alias("m")).filter(f"n >= {least_channels} and top > 0")
    line = p.join(fit.select("arr", "velocity", "m"), "arr").withColumn("_t", F.col("o") / F.greatest("velocity", F.lit(1e-9)))
    return line.groupBy("arr", "velocity").agg(F.greatest(F.lit(0.0), 1 - F.sum(F.expr("w * power(t - _t, 2)")) / (F.sum(F.expr("w * power(t - m, 2)")) + 1e-12)).alias("r2"))


def gather_snr(g: DataFrame, ref: int, velocity: float, near: int = 1, tail: float = 0.3) -> DataFrame:
    """arr, ch, snr: peak near the expected arrival over the RMS of the last lags."""
    f = folded(g).filter("lag > 0")
    d = f.withColumn("_l", F.max("lag").over(Window.partitionBy("arr"))).withColumn("_t", F.abs(F.col("ch") - ref) / F.lit(velocity))
    peak = F.max(F.when(F.abs(F.col("lag") - F.col("_t")) <= near, F.abs("f")))
    rest = F.sqrt(F.avg(F.when(F.col("lag") > F.col("_l") * (1 - tail), F.col("f") * F.col("f"))))
    return d.groupBy("arr", "ch").agg((peak / (rest + 1e-12)).alias("snr"))
