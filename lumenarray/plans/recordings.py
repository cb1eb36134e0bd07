"""From recordings to ledger rows as one plan (R1-R8), and sweeps over
triage thresholds without writing anything (B4, B5).

A recording is an array's channels in chunks, named by `arr`; its geometry
gives sampling rate, spacing and channels, its truth what the catalogue says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarray.functions import signal
from lumenarray.operators import coherence, scoring, triage
from lumenarray.session import cut
from lumenarray.sources.waveforms import CHUNK, finite, traces

EVENT = ["arr", "event_id"]


def prepared(chunks: DataFrame, geometry: DataFrame, band: tuple[float, float] | None = (1.0, 24.0), size: int = CHUNK) -> DataFrame:
    """Chunks with values that are not finite set to 0 and, with a band, filtered
    channel by channel (a channel's whole recording is one row meanwhile).
    Channels too short for the filter, or sampled too slowly, give an error."""
    d = chunks.withColumn("samples", F.transform("samples", lambda x: F.coalesce(finite(x), F.lit(0.0))))
    if not band:
        return d
    out = []
    for (fs,) in geometry.select("fs").distinct().collect():
        mine = d.join(geometry.filter(F.col("fs") == fs).select("arr"), "arr", "left_semi")
        whole = traces(mine.select("arr", "ch", "i0", F.posexplode("samples").alias("p", "a")).select("arr", "ch", (F.col("i0") + F.col("p")).alias("i"), "a"))
        clean = signal.over_traces(whole, lambda x, fs=fs: signal.bandpass(x, fs, *band))
        start = F.explode(F.sequence(F.lit(0), F.size("samples") - 1, F.lit(size)))
        out.append(clean.select("arr", "ch", start.alias("i0"), "samples").select("arr", "ch", "i0", F.slice("samples", F.col("i0") + 1, F.lit(size)).alias("samples")))
    return reduce(DataFrame.unionByName, out)


def analysed(chunks: DataFrame, geometry: DataFrame, size: int = CHUNK) -> DataFrame:
    """Every event of every recording with its verdict, in metres and seconds.

    geometry: arr, fs, dx, n_ch, threshold. Recordings of one geometry and
    threshold go through one plan; only the distinct ones come to the driver.
    """
    out = []
    for g in geometry.select("fs", "dx", "n_ch", "threshold").distinct().collect():
        same = (F.col("fs") == g.fs) & (F.col("dx") == g.dx) & (F.col("n_ch") == g.n_ch) & (F.col("threshold") == g.threshold)
        mine = chunks.join(geometry.filter(same).select("arr"), "arr", "left_semi")
        tier0, cfg = triage.physical(g.fs, g.n_ch, g.threshold), coherence.physical(g.fs, g.dx, threshold=g.threshold)
        fired = cut(triage.sta_lta(mine, tier0, above=tier0.threshold))
        events = cut(triage.extract_events(fired, tier0))
        unit = g.fs * g.dx
        v = coherence.verdicts(coherence.measured(events, mine, fired, cfg, g.fs), cfg)
        spans = events.select(*EVENT, "i_from", "i_to", "ch_min", "ch_max", "n_ch")
        snr = F.lit(g.fs)
        out.append(v.join(spans, EVENT).select(
            *EVENT, "classification", (F.col("v") * unit).alias("apparent_velocity_mps"), "semblance", F.col("f_c").alias("coincidence_fraction"), F.col("n_coherent").cast("int").alias("coherent_channels"), F.col("span").alias("span_fraction"),
            (F.col("speed") * unit).alias("track_speed_mps"), (F.col("v_onset") * unit).alias("v_app_onset_mps"), F.col("onset_r2").alias("onset_fit_r2"), F.col("boundary").alias("boundary_pinned"), F.col("suppressed").alias("suppressed_false_positive"),
            F.struct((F.when(F.col("classification") == coherence.SEISMIC, F.col("t_p")) / snr).alias("t_p_s"), (F.when(F.col("classification") == coherence.SEISMIC, F.col("t_s")) / snr).alias("t_s_s")).alias("phases"), "explanations",
            "i_from", "i_to", "ch_min", "ch_max", "n_ch", (F.col("i_from") / snr).alias("t_start_s"), F.lit(g.fs).alias("fs"),
        ))
    return reduce(DataFrame.unionByName, out)


def decided(events: DataFrame, truth: DataFrame) -> DataFrame:
    """The event that answers each recording's truth, and the outcome.

    truth: arr, magnitude, origin_s, distance_km; one row a recording. With an
    origin the causal candidates compete by verdict, then channels, then time;
    with a magnitude alone the event of most channels in the whole recording
    answers; without truth no event does.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, scoring.PRIORITY)), F.col("classification")), F.lit(9))
    d = events.join(truth, "arr")
    causal = F.col("origin_s").isNotNull() & F.col("t_start_s").between(F.col("origin_s"), F.col("origin_s") + scoring.causal_margin(F.col("distance_km")))
    whole = F.col("origin_s").isNull() & F.col("magnitude").isNotNull()
    kept = [c for c in events.columns if c != "arr"]
    key = F.struct(F.when(causal, rank).otherwise(0).alias("rank"), (-F.col("n_ch")).alias("less"), "t_start_s", "event_id")
    best = d.filter(causal | whole).groupBy("arr").agg(F.min_by(F.struct(*kept), key).alias("b"), F.sum(causal.cast("int")).alias("n_candidates"))
    counts = events.groupBy("arr").agg(F.count("*").alias("n_events"))
    out = truth.join(best, "arr", "left").join(counts, "arr", "left")
    known = F.col("magnitude").isNotNull() | F.col("origin_s").isNotNull()
    answered = F.coalesce(*(F.when(F.col("b.classification") == k, v) for k, v in scoring.ANSWER.items()), F.lit("MISS_SUPPRESSED"))
    outcome = F.when(~known, "CORRECT_REJECTION").when(F.col("origin_s").isNotNull() & F.col("b").isNull(), "MISS_BELOW_FLOOR").otherwise(answered)
    return out.select("arr", "magnitude", "origin_s", "b.*", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates_causal_window"), F.coalesce("n_events", F.lit(0)).alias("n_events_tier0"), outcome.alias("outcome"))


def ledger_rows(chunks: DataFrame, geometry: DataFrame, truth: DataFrame, size: int = CHUNK) -> DataFrame:
    """arr, verdict, outcome, dt_detect_s, snr_observed, metrics_json: what each
    recording adds to the ledger. The ratio is that of the answering event to
    what lies two seconds and more before the origin."""
    won = cut(decided(analysed(chunks, geometry, size), truth))
    ratios = []
    for (fs,) in geometry.select("fs").distinct().collect():
        mine = won.filter((F.col("fs") == fs) & F.col("event_id").isNotNull() & F.col("origin_s").isNotNull()).withColumn("origin_i", F.floor(F.col("origin_s") * fs).cast("int"))
        ratios.append(coherence.observed_snr(mine, chunks, guard=int(2 * fs), least=max(1, int(2 * fs)), size=size))
    metrics = F.when(F.col("event_id").isNotNull(), F.to_json(F.struct("apparent_velocity_mps", "semblance", "coincidence_fraction", "span_fraction", "v_app_onset_mps", "onset_fit_r2", "coherent_channels", "boundary_pinned", "n_events_tier0", "n_candidates_causal_window", (F.col("origin_s").isNull()).alias("evaluated_without_origin"))))
    d = won.join(reduce(DataFrame.unionByName, ratios), EVENT, "left")
    return d.select("arr", F.col("classification").alias("verdict"), "outcome", (F.col("t_start_s") - F.col("origin_s")).alias("dt_detect_s"), F.col("snr").alias("snr_observed"), metrics.alias("metrics_json"))


def threshold_sweep(chunks: DataFrame, geometry: DataFrame, truth: DataFrame, thresholds: tuple[float, ...], size: int = CHUNK) -> DataFrame:
    """array, event_file, candidate, classification, outcome of each recording at
    each triage threshold (event_file: the recording's number)."""
    out = []
    for t in thresholds:
        won = decided(analysed(chunks, geometry.withColumn("threshold", F.lit(float(t))), size), truth)
        out.append(won.select(F.col("arr").cast("string").alias("array"), F.col("arr").cast("string").alias("event_file"), F.lit(float(t)).alias("candidate"), "classification", "outcome"))
    return reduce(DataFrame.unionByName, out)
