"""Tier 2: how an event moves across the array.

Events meet firing cells and chunks of the waves by array and time bucket, so
every operator here works on event windows, never on a file. Channels are
placed by number and times by sample; with the spacing and sampling rate of an
array (see `physical`) the speeds are metres a second.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenarray.functions.signal import envelope, picks
from lumenarray.sources.waveforms import CHUNK, as_chunks, stretches, within

EVENT = ["arr", "event_id"]


@dataclass(frozen=True)
class Coherence:
    """Thresholds of the decision and the band of speeds, here in channels a
    sample. The slownesses are `steps` geometric steps of speed each way."""

    v_low: float = 1 / 3
    v_high: float = 2.0
    steps: int = 36
    use_envelope: bool = True
    least_semblance: float = 0.12
    least_coincidence: float = 0.30
    least_span: float = 0.30
    window: int = 4
    traffic_low: float = 0.05
    traffic_high: float = 2.0
    traffic_r2: float = 0.80
    traffic_duration: int = 3
    isolated: int = 3
    channel_corr: float = 0.30
    regional_coincidence: float = 0.5
    regional_span: float = 0.5
    onset_channels: int = 4
    agreement: float = 0.40
    threshold: float = 4.0
    around: int = 5
    pad: int = 6  # samples round the greatest shift; one second
    half: int = 3  # of that, half
    lookback: int = 72
    lookahead: int = 18

    @property
    def slowness(self) -> tuple[float, ...]:
        return slowness_grid(self.v_low, self.v_high, self.steps)


def physical(fs: float, dx: float, **changes) -> Coherence:
    """The decision for an array sampled fs times a second every dx metres.
    Fixed values: 1,500 to 8,000 m/s, coincidence within 3.5 s, traffic at 2 to
    40 m/s for 3 s, onsets on 30 channels, arrivals from 12 s before an event
    to 3 s after it."""
    unit = 1 / (dx * fs)  # of one metre a second, in channels a sample
    given = {
        "v_low": 1500 * unit, "v_high": 8000 * unit, "window": max(1, int(3.5 * fs)), "traffic_low": 2 * unit, "traffic_high": 40 * unit, "traffic_duration": int(3.0 * fs), "onset_channels": 30,
        "pad": int(fs), "half": int(0.5 * fs), "lookback": int(12 * fs), "lookahead": int(3 * fs),
    }
    return Coherence(**{**given, **changes})


# The verdicts' names.
SEISMIC, TRAFFIC, SUPPRESSED, UNKNOWN, REGIONAL = "SISMO_CONFIRMADO", "FUENTE_MOVIL_TRAFICO", "INCOHERENTE_LOCAL_SUPRIMIDO", "COHERENTE_DESCONOCIDO", "POSIBLE_REGIONAL_EMERGENTE"


def slowness_grid(v_min: float = 1500.0, v_max: float = 8000.0, steps: int = 36) -> tuple[float, ...]:
    """Negative slownesses from slow to fast, then positive ones from fast to
    slow, for speeds in geometric steps."""
    v = [v_min * (v_max / v_min) ** (k / max(1, steps - 1)) for k in range(steps)]
    return (*(-1 / x for x in v), *(1 / x for x in reversed(v)))


def greatest_speed(aperture_m: Column, fs: Column, k: int = 3) -> Column:
    """The greatest apparent speed that an aperture resolves."""
    return aperture_m * fs / k


def span_fraction(events: DataFrame, channels: DataFrame) -> DataFrame:
    """events with span: its channels' extent over the array's channels (arr, n_all)."""
    return events.join(channels, "arr").withColumn("span", (F.col("ch_max") - F.col("ch_min") + 1) / F.col("n_all"))


def span_cells(events: DataFrame, fired: DataFrame, around: int | None = None) -> DataFrame:
    """Firing cells within the time of each event, on its own channels and
    `around` more (None: on all channels of the array)."""
    cells = within(fired, events.select(*EVENT, "i_from", "i_to", "ch_min", "ch_max"), F.col("i_from"), F.col("i_to"))
    return cells if around is None else cells.filter(F.col("ch").between(F.col("ch_min") - around, F.col("ch_max") + around))


def coincidence(events: DataFrame, fired: DataFrame, channels: DataFrame, cfg: Coherence = Coherence()) -> DataFrame:
    """arr, event_id, f_c: the most channels of the whole array that first fire
    within `window` samples, over those that fire (a floor of 5 % of the
    array, 10 at least)."""
    first = span_cells(events, fired).groupBy(*EVENT, "ch").agg(F.min("i").alias("first"))
    near = Window.partitionBy(*EVENT).orderBy("first").rangeBetween(-cfg.window, 0)
    most = first.withColumn("_n", F.count("*").over(near)).groupBy(*EVENT).agg(F.max("_n").alias("most"), F.count("*").alias("n_fired"))
    floor = F.greatest(F.lit(10), F.floor(F.col("n_all") * 0.05))
    return most.join(channels, "arr").select(*EVENT, (F.col("most") / F.greatest("n_fired", floor)).alias("f_c"))


def track_speed(events: DataFrame, fired: DataFrame, cfg: Coherence = Coherence()) -> DataFrame:
    """arr, event_id, speed (channels a sample), r2 of the firing's centroid.

    The centroid of each sample is weighted by the ratio above the threshold;
    the line is fitted with squared weights and judged with plain ones. No row
    for events with under five samples that fire.
    """
    w = F.col("ratio") - cfg.threshold
    near = span_cells(events, fired.filter(F.col("ratio") > cfg.threshold), cfg.around)
    c = near.groupBy(*EVENT, "i").agg(F.sum(w).alias("w"), (F.sum(w * F.col("ch")) / F.sum(w)).alias("c"))
    s2, x, y = F.col("w") * F.col("w"), F.col("i"), F.col("c")
    fit = c.groupBy(*EVENT).agg(F.count("*").alias("n"), F.sum(s2).alias("s"), F.sum(s2 * x).alias("sx"), F.sum(s2 * y).alias("sy"), F.sum(s2 * x * x).alias("sxx"), F.sum(s2 * x * y).alias("sxy"), (F.sum(F.col("w") * y) / F.sum("w")).alias("mean")).filter("n >= 5")
    den = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    fit = fit.filter(den != 0).withColumn("speed", (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / den).withColumn("icpt", (F.col("sy") - F.col("speed") * F.col("sx")) / F.col("s"))
    r = c.join(fit.select(*EVENT, "speed", "icpt", "mean"), EVENT).groupBy(*EVENT, "speed").agg(F.sum(F.col("w") * F.pow(y - F.col("speed") * x - F.col("icpt"), F.lit(2))).alias("res"), F.sum(F.col("w") * F.pow(y - F.col("mean"), F.lit(2))).alias("tot"))
    return r.select(*EVENT, "speed", F.greatest(F.lit(0.0), 1 - F.col("res") / (F.col("tot") + 1e-12)).alias("r2"))


def median_slope(x: np.ndarray, t: np.ndarray, most: int = 4_000_000) -> float:
    """The median of (t[b] - t[a]) / (x[b] - x[a]) over all pairs of places in
    order. Beyond `most` pairs they are gone through in blocks: a bracket round
    the median is narrowed until the slopes in it are few, and these sorted."""
    n = len(x)
    pairs = n * (n - 1) // 2

    def blocks() -> Iterator[np.ndarray]:
        step = max(1, most // n)
        for a in range(0, n - 1, step):
            i, j = np.nonzero(np.arange(a, min(a + step, n - 1))[:, None] < np.arange(n))
            yield (t[j] - t[a + i]) / (x[j] - x[a + i])

    if pairs <= most:
        return float(np.median(np.concatenate(list(blocks()))))
    ranks = ((pairs - 1) // 2, pairs // 2)
    low, high = -np.inf, np.inf
    for s in blocks():
        q = np.quantile(s, (0.0, 1.0))
        low, high = (min(low, q[0]), max(high, q[1])) if np.isfinite(low) else (q[0], q[1])
    below = 0
    while True:
        edges = np.linspace(low, high, 1025)
        count = sum(np.histogram(s, edges)[0] for s in blocks())
        up = below + np.cumsum(count)
        a, b = np.searchsorted(up, ranks, side="right")
        below, low, high = int(up[a] - count[a]), edges[a], edges[b + 1]
        inside = int(count[a : b + 1].sum())
        if inside <= most or high - low <= 1e-12 * max(abs(low), abs(high), 1e-12):
            # the last of histogram's bins holds its upper edge, the others don't
            kept = np.sort(np.concatenate([s[(s >= low) & ((s < high) | (b == 1023) & (s == high))] for s in blocks()]))
            return float((kept[ranks[0] - below] + kept[ranks[1] - below]) / 2)


def onset_velocity(events: DataFrame, fired: DataFrame, cfg: Coherence = Coherence()) -> DataFrame:
    """arr, event_id, v_onset (channels a sample), r2: the median of pairwise
    slopes of first firings (Theil-Sen); infinite for a flat onset. Only the
    channels of one event, with their first firings, are gathered."""
    first = span_cells(events, fired, 0).groupBy(*EVENT, "ch").agg(F.min("i").alias("t"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ch")
        x, t = g["ch"].to_numpy(float), g["t"].to_numpy(float)
        if len(x) < cfg.onset_channels:
            return pd.DataFrame(columns=["arr", "event_id", "v_onset", "r2"])
        slope = median_slope(x, t)
        residual = t - slope * x - (np.median(t) - slope * np.median(x))
        r2 = max(0.0, 1 - float((residual**2).sum()) / (float(((t - t.mean()) ** 2).sum()) + 1e-12))
        return pd.DataFrame({"arr": [g["arr"].iloc[0]], "event_id": [g["event_id"].iloc[0]], "v_onset": [math.inf if abs(slope) < 1e-9 else 1 / slope], "r2": [r2]})

    return first.groupBy(*EVENT).applyInPandas(fit, "arr bigint, event_id string, v_onset double, r2 double")


def margin_of(cfg: Coherence, channels: Column) -> Column:
    """Samples that an event's window needs on each side, so that no shift of
    the slant stack leaves it: over so many channels, and `pad` more."""
    return (F.ceil(max(map(abs, cfg.slowness)) * (channels - 1)) + cfg.pad).cast("int")


def event_window(events: DataFrame, waves: DataFrame, cfg: Coherence = Coherence(), size: int = CHUNK) -> DataFrame:
    """The cells of an event's channels, margin_of samples wider on each side;
    x is the channel's place from the event's first."""
    margin = margin_of(cfg, F.col("ch_max") - F.col("ch_min") + 1)
    low, high = F.col("i_from") - margin, F.col("i_to") + margin
    d = stretches(as_chunks(waves, size), events.select(*EVENT, "i_from", "i_to", "ch_min", "ch_max"), low, high, size).filter("ch between ch_min and ch_max")
    d = d.select(*EVENT, "i_from", "i_to", low.alias("_a"), high.alias("_z"), (F.col("ch") - F.col("ch_min")).alias("x"), "i0", F.posexplode("samples").alias("_p", "a"))
    return d.withColumn("i", F.col("i0") + F.col("_p")).filter("i between _a and _z").select(*EVENT, "i_from", "i_to", "x", "i", "a")


def slant_stack(window: np.ndarray, margin: int, slowness: np.ndarray, use_envelope: bool) -> tuple[np.ndarray, np.ndarray]:
    """Semblance of each slowness over the window's core (margin samples off
    each side), and the traces that it is taken of."""
    traces = envelope(window) if use_envelope else window
    n_ch, n = traces.shape
    core = np.arange(margin, n - margin)
    centred = traces - traces[:, core].mean(axis=1, keepdims=True)
    x, out = np.arange(n_ch), np.zeros(len(slowness))
    for k, p in enumerate(slowness):
        g = centred[x[:, None], np.clip(core + np.rint(p * x).astype(np.int64)[:, None], 0, n - 1)]
        stack = g.sum(axis=0)
        out[k] = float((stack * stack).sum()) / (n_ch * float((g * g).sum()) + 1e-20)
    return out, traces


def coherent_count(traces: np.ndarray, margin: int, p: float, least: float) -> int:
    """Channels whose shifted core correlates with the mean of all above `least`."""
    n_ch, n = traces.shape
    x, core = np.arange(n_ch), np.arange(margin, n - margin)
    g = traces[x[:, None], np.clip(core + np.rint(p * x).astype(np.int64)[:, None], 0, n - 1)]
    g = g - g.mean(axis=1, keepdims=True)
    beam = g.mean(axis=0)
    corr = (g @ beam) / ((np.linalg.norm(g, axis=1) + 1e-12) * (np.linalg.norm(beam) + 1e-12))
    return int((np.round(corr, 9) > least).sum())


def wide_beam(window: np.ndarray, first: int, event: tuple[int, int], p: float, cfg: Coherence, fs: float) -> tuple[np.ndarray, int]:
    """Mean of the shifted envelopes from `lookback` samples before the event to
    `lookahead` after it, and the sample it begins at. window begins at sample
    `first`; where less than two seconds are left inside the greatest shift,
    all of it is taken."""
    shift = math.ceil(abs(p) * (len(window) - 1)) + 1
    a = max(0, event[0] - cfg.lookback - shift - first)
    b = min(window.shape[1], event[1] + 1 + cfg.lookahead + shift - first)
    env = envelope(window[:, a:b])
    n = env.shape[1]
    core = np.arange(shift, n - shift) if n - 2 * shift >= int(2 * fs) else np.arange(n)
    x = np.arange(len(env))
    beam = env[x[:, None], np.clip(core + np.rint(p * x).astype(np.int64)[:, None], 0, n - 1)].mean(axis=0)
    return beam, first + a + int(core[0]) if len(core) else first + a


STACK = "arr bigint, event_id string, semblances array<double>, k int, p double, semblance double, boundary boolean, v double, n_coherent bigint, t_p double, t_s double"


def stacked(events: DataFrame, waves: DataFrame, cfg: Coherence = Coherence(), fs: float | None = None, size: int = CHUNK) -> DataFrame:
    """One pass over each event's window (STACK): the semblance of every
    slowness, the best one, whether it is at an end of its direction or not
    strictly above both neighbours there (boundary), and the channels that
    cohere with it. With fs, also P and S arrivals (samples) on the wide beam.

    Windows end where the recording does; shifts beyond are clipped. Ties take
    the first slowness, semblances being compared to nine digits.
    """
    grid, steps = np.array(cfg.slowness), cfg.steps
    margin = margin_of(cfg, F.col("ch_max") - F.col("ch_min") + 1)
    reach = F.greatest(margin, F.lit(cfg.lookback) + margin) if fs else margin
    e = events.select(*EVENT, "i_from", "i_to", "ch_min", "ch_max").withColumn("margin", margin).withColumn("low", F.col("i_from") - reach).withColumn("high", F.col("i_to") + (F.lit(cfg.lookahead) + margin if fs else margin))
    d = stretches(as_chunks(waves, size), e, F.col("low"), F.col("high"), size).filter("ch between ch_min and ch_max").select(*EVENT, "i_from", "i_to", "ch_min", "ch_max", "margin", "low", "high", "ch", "i0", F.col("samples").cast("array<double>").alias("samples"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        one = g.iloc[0]
        ends = g["i0"].to_numpy() + g["samples"].map(len).to_numpy()
        first, last = max(int(one["low"]), int(g["i0"].min()), 0), min(int(one["high"]) + 1, int(ends.max()))
        window = np.zeros((int(one["ch_max"] - one["ch_min"]) + 1, last - first))
        for ch, i0, samples in zip(g["ch"], g["i0"], g["samples"], strict=True):
            a, b = max(first, i0), min(last, i0 + len(samples))
            if a < b:
                window[ch - one["ch_min"], a - first : b - first] = samples[a - i0 : b - i0]
        low, high = max(first, int(one["i_from"] - one["margin"])), min(last, int(one["i_to"] + one["margin"]) + 1)
        near = window[:, low - first : high - first]
        margin = max(1, min(int(one["margin"]), (near.shape[1] - cfg.half) // 2))
        if near.shape[1] <= 2 * margin:
            return pd.DataFrame(columns=[c.split()[0] for c in STACK.split(", ")])
        curve, traces = slant_stack(near, margin, grid, cfg.use_envelope)
        sharp = np.round(curve, 9)
        k = int(sharp.argmax())
        inner = k not in (0, steps - 1, steps, 2 * steps - 1) and sharp[k] > sharp[k - 1] and sharp[k] > sharp[k + 1]
        t_p = t_s = None
        if fs:
            beam, start = wide_beam(window, first, (int(one["i_from"]), int(one["i_to"])), float(grid[k]), cfg, fs)
            t_p, t_s = (None if t is None else start + t * fs for t in picks(beam, fs))
        row = {"arr": one["arr"], "event_id": one["event_id"], "semblances": curve.tolist(), "k": k, "p": float(grid[k]), "semblance": min(1.0, max(0.0, float(curve[k]))), "boundary": not inner, "v": 1 / float(grid[k]), "n_coherent": coherent_count(traces, margin, float(grid[k]), cfg.channel_corr), "t_p": t_p, "t_s": t_s}
        return pd.DataFrame([row])

    # windows are small and their stack is dear: an explicit number of parts keeps
    # them from being coalesced by size, on the keys that the grouping asks for
    parts = int(waves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, *EVENT).groupBy(*EVENT).applyInPandas(run, STACK)


def semblance(stack: DataFrame, cfg: Coherence = Coherence()) -> DataFrame:
    """arr, event_id, k, p, semblance: the curve of each event."""
    grid = F.array(*map(F.lit, cfg.slowness))
    return stack.select(*EVENT, F.posexplode("semblances").alias("k", "semblance")).select(*EVENT, "k", F.element_at(grid, F.col("k") + 1).alias("p"), "semblance")


def concordant(v1: Column, v2: Column, tolerance: float) -> Column:
    """Two speeds agree in size; an infinite or missing one agrees with none."""
    a, b = F.abs(v1), F.abs(v2)
    return F.coalesce(~F.isnan(a - b) & (b < float("inf")) & (F.abs(a - b) <= tolerance * (a + b) / 2), F.lit(False))


def verdicts(metrics: DataFrame, cfg: Coherence = Coherence()) -> DataFrame:
    """The decision, in order: isolated, seismic, traffic, regional, suppressed,
    unknown. metrics: n_ch, span, f_c, v, semblance, boundary, v_onset, speed,
    r2, duration, n_coherent; what a branch doesn't measure is null."""
    seismic = (F.col("f_c") >= cfg.least_coincidence) & (F.col("span") >= cfg.least_span) & ~F.col("boundary") & (F.col("semblance") >= cfg.least_semblance) & F.abs("v").between(cfg.v_low, cfg.v_high) & concordant(F.col("v"), F.col("v_onset"), cfg.agreement)
    traffic = F.abs("speed").between(cfg.traffic_low, cfg.traffic_high) & (F.col("r2") >= cfg.traffic_r2) & (F.col("duration") >= cfg.traffic_duration)
    regional = (F.col("f_c") >= cfg.regional_coincidence) & (F.col("span") >= cfg.regional_span)
    weak = (F.coalesce("n_coherent", F.lit(0)) <= cfg.isolated) & (F.coalesce("semblance", F.lit(0.0)) < cfg.least_semblance) & (F.col("f_c") < cfg.regional_coincidence) & (F.col("span") < cfg.regional_span)
    kind = F.when(F.col("n_ch") <= cfg.isolated, SUPPRESSED).when(F.coalesce(seismic, F.lit(False)), SEISMIC).when(F.coalesce(traffic, F.lit(False)), TRAFFIC).when(F.coalesce(regional, F.lit(False)), REGIONAL).when(F.coalesce(weak, F.lit(False)), SUPPRESSED).otherwise(UNKNOWN)
    d = metrics.withColumn("classification", kind)
    shown = lambda c, *kinds: F.when(F.col("classification").isin(*kinds), F.col(c)).alias(c)
    why = F.array_compact(F.array(
        F.format_string("coincidence %.1f %%", F.col("f_c") * 100),
        F.when(F.col("semblance").isNotNull(), F.format_string("semblance %.3f", "semblance")),
        F.when(F.col("boundary"), F.lit("the peak is at the edge of the velocity grid")),
        F.when(F.col("speed").isNotNull(), F.format_string("track %.1f channels a sample", "speed")),
    ))
    return d.select(*EVENT, "classification", shown("v", SEISMIC, TRAFFIC, REGIONAL, UNKNOWN), "semblance", "f_c", "span", "n_coherent", shown("speed", TRAFFIC, REGIONAL, UNKNOWN), "v_onset", (F.col("classification") == SUPPRESSED).alias("suppressed"), why.alias("explanations"), *(c for c in ("boundary", "onset_r2", "t_p", "t_s") if c in metrics.columns))


def measured(events: DataFrame, waves: DataFrame, fired: DataFrame, cfg: Coherence = Coherence(), fs: float | None = None) -> DataFrame:
    """The metrics row of each event. Isolated events skip the slant stack."""
    channels = waves.groupBy("arr").agg(F.count_distinct("ch").alias("n_all"))
    wide = events.filter(F.col("n_ch") > cfg.isolated)
    out = span_fraction(events, channels).drop("n_all").join(coincidence(events, fired, channels, cfg), EVENT, "left")
    out = out.join(stacked(wide, waves, cfg, fs).drop("semblances", "k", "p"), EVENT, "left")
    onset = onset_velocity(wide, fired, cfg).select(*EVENT, "v_onset", F.col("r2").alias("onset_r2"))
    out = out.join(track_speed(wide, fired, cfg), EVENT, "left").join(onset, EVENT, "left")
    return out.withColumn("duration", F.col("i_to") - F.col("i_from") + 1)


def observed_snr(events: DataFrame, waves: DataFrame, guard: int = 2, least: int = 2, size: int = CHUNK) -> DataFrame:
    """arr, event_id, snr: RMS of the event over the RMS before the origin
    (column origin_i; the event's start where there is none), less `guard`
    samples; each the median over the event's channels. No row where fewer
    than `least` samples or only silence lie before it.

    The energy before is taken from running sums of the chunks and the few
    samples of one chunk, so an event doesn't meet its whole recording.
    """
    origin = F.coalesce("origin_i", "i_from") if "origin_i" in events.columns else F.col("i_from")
    e = events.select(*EVENT, "i_from", "i_to", "ch_min", "ch_max", (origin - guard).alias("quiet")).filter(F.col("quiet") >= least)
    energy = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    up = Window.partitionBy("arr", "ch").orderBy("i0").rowsBetween(Window.unboundedPreceding, -1)
    chunks = as_chunks(waves, size)
    # one small row a chunk
    sums = chunks.select("arr", "ch", "i0", energy(F.col("samples")).alias("e")).select("arr", "ch", "i0", F.coalesce(F.sum("e").over(up), F.lit(0.0)).alias("before"))
    last = F.floor((F.col("quiet") - 1) / size) * size
    here = chunks.join(e.withColumn("i0", last.cast("int")), ["arr", "i0"]).filter("ch between ch_min and ch_max").join(sums, ["arr", "ch", "i0"])
    noise = here.select(*EVENT, "ch", F.sqrt((F.col("before") + energy(F.slice("samples", F.lit(1), F.col("quiet") - F.col("i0")))) / F.col("quiet")).alias("n"))
    own = stretches(chunks, e, F.col("i_from"), F.col("i_to"), size).filter("ch between ch_min and ch_max")
    start = F.greatest(F.col("i_from") - F.col("i0"), F.lit(0))
    stop = F.least(F.col("i_to") + 1 - F.col("i0"), F.size("samples"))
    signal = own.filter(stop > start).groupBy(*EVENT, "ch").agg(F.sqrt(F.sum(energy(F.slice("samples", start + 1, stop - start))) / F.sum(stop - start)).alias("s"))
    per = signal.join(noise, [*EVENT, "ch"], "full")
    return per.groupBy(*EVENT).agg(F.median("s").alias("s"), F.median("n").alias("n")).filter("n > 0 and s is not null").select(*EVENT, (F.col("s") / F.col("n")).alias("snr"))
