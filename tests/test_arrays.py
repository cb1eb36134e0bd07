"""Triage, coherence, interferometry and signal kernels on small arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenarray.functions import signal
from lumenarray.operators import coherence, interferometry, triage
from lumenarray.plans.inference import micro_batched
from lumenarray.sources import recordings, waveforms


def cells(spark, m, arr=0):
    rows = [(arr, ch, i, int(a)) for ch, row in enumerate(m) for i, a in enumerate(row)]
    return spark.createDataFrame(rows, "arr bigint, ch int, i int, a bigint")


def test_ratio_against_a_loop(spark):
    cfg = triage.Tier0()
    r = np.random.default_rng(1)
    m = r.integers(0, 50, (3, 80))
    got = {(x.ch, x.i): x.ratio for x in triage.sta_lta(cells(spark, m), cfg).collect()}
    for ch in range(3):
        for i in range(80):
            p = m[ch].astype(float) ** 2
            want = 1.0 if i < cfg.warm else p[i - 2 : i + 1].mean() / (p[i - 28 : i - 4].mean() + 1e-12 * float(m.max()) ** 2)
            assert got[ch, i] == pytest.approx(want)


def test_islands_against_a_loop(spark):
    rng = random.Random(2)
    for merge in (0, 1, 3):
        points = sorted(rng.sample(range(100), 40))
        runs, last = [], None
        for p in points:
            if last is None or p - last - 1 > merge:
                runs.append([p, p])
            runs[-1][1] = last = p
        df = spark.createDataFrame([(0, p) for p in points], "arr bigint, i int")
        got = triage.islands(df, ["arr"], merge, width=16).groupBy("run").agg(F.min("i").alias("a"), F.max("i").alias("b")).orderBy("a")
        assert [[r.a, r.b] for r in got.collect()] == runs


def test_no_trigger_while_warming_up(spark):
    m = np.random.default_rng(3).integers(-9, 9, (4, 60))
    assert triage.raster(triage.sta_lta(cells(spark, m))).filter(F.col("i") < triage.Tier0().warm).count() == 0


def test_a_plane_wave_has_its_slowness(spark):
    m = np.zeros((10, 120))
    wave = [3, 9, -12, 20, -12, 9, 3]
    for ch in range(10):
        m[ch, 50 + ch : 57 + ch] += wave
    ev = spark.createDataFrame([(0, "e", 48, 70, 0, 9, 10)], "arr bigint, event_id string, i_from int, i_to int, ch_min int, ch_max int, n_ch bigint")
    for enveloped in (True, False):
        cfg = coherence.Coherence(use_envelope=enveloped, steps=12)
        best = coherence.stacked(ev, cells(spark, m), cfg).first()
        assert abs(best.v - 1.0) < 0.1 and not best.boundary and best.semblance > 0.9 and best.n_coherent == 10
    curve = coherence.semblance(coherence.stacked(ev, cells(spark, m), cfg), cfg).orderBy("k").collect()
    assert len(curve) == 24 and curve[0].p == pytest.approx(-3) and curve[-1].p == pytest.approx(3)
    fired = cells(spark, (np.abs(m) > 2).astype(int)).filter("a > 0").withColumn("ratio", F.lit(9.0))
    assert coherence.onset_velocity(ev, fired, cfg).first().v_onset == 1.0


def test_windows_over_chunk_ends(spark):
    r = np.random.default_rng(12)
    m = r.integers(-9, 9, (4, 200))
    ev = spark.createDataFrame([(0, "e", 60, 75, 0, 3, 4), (0, "start", 2, 9, 0, 3, 4), (0, "end", 190, 199, 1, 2, 2)], "arr bigint, event_id string, i_from int, i_to int, ch_min int, ch_max int, n_ch bigint")
    one, many = ({x.event_id: x for x in coherence.stacked(ev, waveforms.chunked(cells(spark, m), size), size=size).collect()} for size in (512, 16))
    assert one.keys() == {"e", "start", "end"} and all(one[k].semblances == pytest.approx(many[k].semblances) for k in one)
    a, b = ({(x.event_id): x.snr for x in coherence.observed_snr(ev, waveforms.chunked(cells(spark, m), size), size=size).collect()} for size in (512, 16))
    e = m[:, 60:76].astype(float), m[:, :58].astype(float)
    want = np.median(np.sqrt((e[0] ** 2).mean(axis=1))) / np.median(np.sqrt((e[1] ** 2).mean(axis=1)))
    assert a["e"] == pytest.approx(want) and a == pytest.approx(b) and "start" not in a


def test_median_slope_in_blocks():
    r = np.random.default_rng(13)
    for n in (9, 60, 151):
        x, t = np.sort(r.choice(5000, n, replace=False)).astype(float), r.integers(0, 40, n).astype(float)
        want = np.median([(t[j] - t[i]) / (x[j] - x[i]) for i in range(n) for j in range(i + 1, n)])
        assert coherence.median_slope(x, t) == pytest.approx(want) and coherence.median_slope(x, t, most=300) == pytest.approx(want)


def test_physical_decision():
    c = coherence.physical(100.0, 8.0)
    assert c.v_low == pytest.approx(1500 / 800) and c.v_high == pytest.approx(10) and (c.pad, c.half, c.window) == (100, 50, 350)
    beam, start = coherence.wide_beam(np.ones((3, 4000)), 0, (2000, 2100), 1.0, c, 100.0)
    assert start == 2000 - 1200 and len(beam) == 1200 + 101 + 300


def test_silent_and_broken_arrays(spark):
    c = cells(spark, np.zeros((2, 60)))
    assert {x.ratio for x in triage.sta_lta(c).collect()} == {1.0}
    odd = cells(spark, np.ones((2, 60))).withColumn("a", F.when(F.col("i") == 40, float("nan")).otherwise(F.col("a").cast("double")))
    assert {x.ratio for x in triage.sta_lta(odd).collect()} == {1.0}


def test_ratio_across_chunks_and_gaps(spark):
    m = np.random.default_rng(14).integers(0, 50, (2, 200))
    c = cells(spark, m)
    whole, parts = ({(x.ch, x.i): x.ratio for x in triage.sta_lta(waveforms.chunked(c, size)).collect()} for size in (512, 40))
    assert whole == pytest.approx(parts)


def test_verdict_order(spark):
    schema = "arr bigint, event_id string, n_ch bigint, span double, f_c double, v double, semblance double, boundary boolean, v_onset double, speed double, r2 double, duration int, n_coherent bigint"
    inf = float("inf")
    rows = [
        (0, "alone", 3, 0.9, 0.9, 1.0, 0.9, False, 1.0, 0.5, 0.9, 9, 9), (0, "seismic", 9, 0.9, 0.9, 1.0, 0.9, False, 1.1, 0.5, 0.9, 9, 9), (0, "discordant", 9, 0.9, 0.9, 1.0, 0.9, False, inf, None, None, 9, 9),
        (0, "edge", 9, 0.9, 0.9, 1.0, 0.9, True, 1.0, None, None, 9, 9), (0, "car", 9, 0.1, 0.1, 1.0, 0.9, False, None, -0.5, 0.9, 9, 9), (0, "weak", 9, 0.1, 0.1, 1.0, 0.01, False, None, None, None, 9, 2),
        (0, "unknown", 9, 0.1, 0.1, 1.0, 0.9, False, None, None, None, 9, 9), (0, "nulls", 9, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.event_id: r.classification for r in coherence.verdicts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"alone": coherence.SUPPRESSED, "seismic": coherence.SEISMIC, "discordant": coherence.REGIONAL, "edge": coherence.REGIONAL, "car": coherence.TRAFFIC, "weak": coherence.SUPPRESSED, "unknown": coherence.UNKNOWN, "nulls": coherence.UNKNOWN}


def test_slowness_grid():
    g = coherence.slowness_grid()
    assert len(g) == 72 and g[0] == -1 / 1500 and g[-1] == pytest.approx(1 / 1500) and g[35] == pytest.approx(-1 / 8000)


def test_gather_finds_the_delay(spark):
    m = np.random.default_rng(5).integers(-50, 50, (1, 400))
    m = np.array([np.roll(m[0], 2 * ch) for ch in range(9)])
    g = interferometry.gather(cells(spark, m), ref=0, lags=20, window=200, hop=100)
    best = g.groupBy("ch").agg(F.max_by("lag", "ncf").alias("lag")).orderBy("ch").collect()
    assert [r.lag for r in best] == [2 * ch for ch in range(9)]


def test_bandpass_and_envelope():
    fs, t = 50.0, np.arange(1000) / 50
    inside, outside = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 0.05 * t)
    y = signal.bandpass(np.array([inside, outside]), fs, 1.0, 20.0)
    assert np.abs(y[0, 100:-100] - inside[100:-100]).max() < 0.01 and np.abs(y[1, 100:-100]).max() < 0.01
    w = np.exp(2j * np.pi * np.array([1.0, 20.0]) / fs)
    gain = np.prod([np.polyval(b, w) / np.polyval(a, w) for b, a in signal.butterworth(fs, 1.0, 20.0)], axis=0)
    assert np.abs(gain) == pytest.approx([2**-0.5] * 2, abs=1e-6)
    assert signal.envelope(np.array([inside]))[0, 100:-100] == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        signal.butterworth(fs, 1.0, 25.0)


def test_whitening_and_waves():
    x = np.random.default_rng(6).normal(size=(2, 512))
    s = np.abs(np.fft.rfft(signal.whitened(x, 50.0, 4.0, 16.0), axis=1))
    f = np.fft.rfftfreq(512, 1 / 50)
    assert s[:, (f > 4) & (f < 16)] == pytest.approx(1, abs=1e-6) and s[:, f > 18].max() < 1e-6
    w = signal.ricker(6.0, 50.0)
    out = signal.plane_wave(np.zeros((5, 200)), 50.0, 8.0, 400.0, 1.0, w, 2.0)
    assert [int(np.abs(row).argmax()) for row in out] == [50 + ch + len(w) // 2 for ch in range(5)]


def test_picks_find_both_arrivals():
    fs = 50.0
    t = np.arange(int(30 * fs)) / fs
    rng = np.random.default_rng(8)
    beam = np.abs(rng.normal(size=len(t)) * 0.05) + 1.0 * np.exp(-np.maximum(t - 12, 0) / 0.6) * (t >= 12) + 5 * np.exp(-np.maximum(t - 18, 0) / 0.8) * (t >= 18)
    p, s = signal.picks(beam, fs)
    assert abs(p - 12) < 0.4 and abs(s - 18) < 0.4
    assert signal.picks(np.ones(100), fs) == (None, None)


def test_waveform_transforms(spark):
    m = np.array([[1, 4, 9], [1, 1, 1]])
    c = cells(spark, m)
    assert sorted((r.ch, r.i, r.a) for r in waveforms.derivative(c, 2.0).collect()) == [(0, 0, 6), (0, 1, 10), (1, 0, 0), (1, 1, 0)]
    assert waveforms.dead_channels(c).collect()[0].ch == 1
    assert waveforms.oriented(c, "tc").filter("ch = 2 and i = 0").first().a == 9
    assert waveforms.oriented(c).filter("ch = 0 and i = 2").first().a == 9
    two = c.withColumn("file", F.lit("b")).unionByName(c.withColumn("file", F.lit("a")))
    assert waveforms.concatenated(two).agg(F.max("i")).first()[0] == 5
    odd = spark.createDataFrame([(0, 0, 0, float("nan")), (0, 0, 1, None), (0, 0, 2, float("inf")), (0, 0, 3, 2.0)], "arr bigint, ch int, i int, a double")
    assert [r.a for r in waveforms.sanitized(odd).orderBy("i").collect()] == [0, 0, 0, 2]
    spans = spark.createDataFrame([("x", 60.0, 30.0), ("y", 60.0, None), ("z", 60.0, 3.0)], "file string, length_s double, origin_s double")
    assert sorted((r.file, r.from_s, r.to_s) for r in waveforms.quiet_stretches(spans).collect()) == [("x", 0, 25), ("x", 35, 60), ("y", 0, 60), ("z", 8, 60)]


def test_recordings_round_trip(spark, tmp_path):
    m = np.random.default_rng(7).normal(size=(3, 20)).astype(np.float32)
    head = bytearray(3600)
    for at, v in ((3216, 10_000), (3220, 20), (3224, 5)):
        head[at : at + 2] = v.to_bytes(2, "big")
    (tmp_path / "a.sgy").write_bytes(bytes(head) + b"".join(bytes(240) + row.astype(">f4").tobytes() for row in m))
    (tmp_path / "b.sgy").write_bytes(bytes(head) + b"short")
    np.savez(tmp_path / "c.npz", data=m)
    rows = recordings.read(spark, f"file://{tmp_path}/*.sgy", "segy").collect()
    good = sorted((r for r in rows if r.error is None), key=lambda r: r.ch)
    assert [r.fs for r in good] == [100.0] * 3 and np.allclose([r.samples for r in good], m)
    assert [r.file for r in rows if r.error] == ["b.sgy"]
    assert np.allclose([r.samples for r in sorted(recordings.read(spark, f"file://{tmp_path}/*.npz", "npz").collect(), key=lambda r: r.ch)], m)


def test_ground_truth(spark):
    rows = [("a", 1.0, -1, "", None, None), ("b", None, 5, "t", 1.0, 2.0), ("c", None, -1, "t", None, None), ("d", None, None, None, None, None)]
    got = {r.file: r.truth for r in recordings.ground_truth(spark.createDataFrame(rows, "file string, magnitude double, event_time_index int, event_time string, latitude double, longitude double")).collect()}
    assert got["a"].magnitude == 1.0 and got["b"].origin_time == "t" and got["c"] is None and got["d"] is None


def test_a_bad_batch_fails_alone(spark):
    t = spark.createDataFrame([(0, k, [float(k)] * (1 + k // 4)) for k in range(8)], "arr bigint, ch int, samples array<double>")

    def infer(x):
        if x.shape[1] == 2:
            raise RuntimeError("no")
        return x.sum(axis=1).tolist()

    got = {r.ch: (r.result, r.error) for r in micro_batched(t, infer, 3).collect()}
    assert [got[k] for k in range(4)] == [(f"{float(k)}", None) for k in range(4)] and all(got[k] == (None, "no") for k in range(4, 8))
    wrong = micro_batched(t, lambda x: [1] * (len(x) + 1), 3).filter("error is null")
    assert wrong.count() == 0


def test_live_gaps_and_late_chunks():
    from lumenarray.streaming.triage import ratios

    cfg = triage.Tier0()
    x = np.random.default_rng(15).integers(1, 9, 80)
    whole = ratios(x, np.zeros(0, np.int64), 0, cfg)
    assert whole[:29].tolist() == [1.0] * 29
    assert ratios(x[40:], x[11:40], 40, cfg) == pytest.approx(whole[40:])


def test_gather_of_a_tracked_event(spark):
    m = np.random.default_rng(16).integers(-50, 50, (1, 600))
    m = np.array([np.roll(m[0], 2 * ch) for ch in range(7)])
    ev = spark.createDataFrame([(0, "car", 100, 400, 1, 5)], "arr bigint, event_id string, i_from int, i_to int, ch_min int, ch_max int")
    g = interferometry.gather_of_events(ev, cells(spark, m), lags=20, window=100, hop=50, pad=50)
    best = g.groupBy("event_id", "ch").agg(F.max_by("lag", "ncf").alias("lag")).orderBy("ch").collect()
    assert [(r.event_id, r.lag) for r in best] == [("car", 2 * (ch - 3)) for ch in range(7)]


def test_rates_must_agree(spark):
    c = cells(spark, np.ones((1, 3))).withColumn("file", F.lit("a")).withColumn("fs", F.lit(50.0))
    other = c.withColumn("file", F.lit("b")).withColumn("fs", F.lit(100.0))
    assert waveforms.concatenated(c.unionByName(c.withColumn("file", F.lit("b")))).count() == 6
    with pytest.raises(Exception, match="sampling rate"):
        waveforms.concatenated(c.unionByName(other)).collect()


def quake(n_ch=60, fs=50.0, dx=50.0, speed=3000.0, seconds=40, at=22.0, seed=20):
    """Noise with a plane wave, and its speed."""
    r = np.random.default_rng(seed)
    data = r.normal(size=(n_ch, int(seconds * fs)))
    return signal.plane_wave(data, fs, dx, speed, at, signal.ricker(6.0, fs), 30.0)


def recorded(spark, arrays):
    rows = [(arr, ch, a, row[a : a + 512].tolist()) for arr, m in arrays.items() for ch, row in enumerate(m) for a in range(0, len(row), 512)]
    chunks = spark.createDataFrame(rows, "arr bigint, ch int, i0 int, samples array<double>")
    return chunks, spark.createDataFrame([(arr, 50.0, 50.0, len(m), 4.0) for arr, m in arrays.items()], "arr bigint, fs double, dx double, n_ch int, threshold double")


def test_recordings_to_ledger_rows(spark):
    from lumenarray.plans import recordings as plan

    quiet = np.random.default_rng(21).normal(size=(60, 2000))
    arrays = {1: quake(), 2: quake(speed=-5000.0, seed=22), 3: quiet, 4: quake(), 5: quake(), 6: quake(seed=23)}
    arrays[6][3, 700:720] = np.nan
    chunks, geometry = recorded(spark, arrays)
    clean = plan.prepared(chunks, geometry, band=None)
    truth = spark.createDataFrame([(1, 2.0, 21.0, None), (2, 2.0, 21.0, 1.0), (3, 1.0, 21.0, None), (4, 2.0, None, None), (5, None, None, None), (6, 2.0, 30.0, None)], "arr bigint, magnitude double, origin_s double, distance_km double")
    ev = {r.arr: r for r in plan.analysed(clean, geometry).orderBy("n_ch").collect()}
    assert ev[1].classification == coherence.SEISMIC and abs(ev[1].apparent_velocity_mps / 3000 - 1) < 0.08 and abs(ev[1].v_app_onset_mps / 3000 - 1) < 0.15
    assert abs(ev[2].apparent_velocity_mps / -5000 - 1) < 0.08 and ev[1].phases.t_p_s is not None
    rows = {r.arr: r for r in plan.ledger_rows(clean, geometry, truth).collect()}
    assert {k: r.outcome for k, r in rows.items()} == {1: "HIT", 2: "HIT", 3: "MISS_BELOW_FLOOR", 4: "HIT", 5: "CORRECT_REJECTION", 6: "MISS_BELOW_FLOOR"}
    assert 0 < rows[1].dt_detect_s < 2 and rows[1].snr_observed > 3 and rows[4].dt_detect_s is None and rows[4].snr_observed is None and rows[3].verdict is None
    assert '"evaluated_without_origin":true' in rows[4].metrics_json
    sweep = plan.threshold_sweep(clean.filter("arr < 3"), geometry.filter("arr < 3"), truth.filter("arr < 3"), (4.0, 1e9))
    assert {(r.array, r.candidate, r.outcome) for r in sweep.collect()} == {(a, c, o) for a in "12" for c, o in ((4.0, "HIT"), (1e9, "MISS_BELOW_FLOOR"))}


def test_filtered_recordings_keep_their_shape(spark):
    from lumenarray.plans import recordings as plan

    chunks, geometry = recorded(spark, {1: quake(n_ch=3, seconds=20)})
    got = {(r.ch, r.i0): r.samples for r in plan.prepared(chunks, geometry).collect()}
    want = signal.bandpass(quake(n_ch=3, seconds=20), 50.0)
    assert all(np.allclose(s, want[ch, i0 : i0 + 512]) for (ch, i0), s in got.items()) and len(got) == 6


def test_inspection_and_attributes(spark, tmp_path):
    np.savez(tmp_path / "a.npz", data=np.zeros((3, 20), np.float32), other=np.zeros(4))
    (tmp_path / "b.npz").write_bytes(b"broken")
    got = {(r.file, r.dataset): (r.shape, r.dtype, bool(r.error)) for r in recordings.inspected(spark, f"file://{tmp_path}/*.npz", "npz").collect()}
    assert got == {("a.npz", "data"): ([3, 20], "float32", False), ("a.npz", "other"): ([4], "float64", False), ("b.npz", None): (None, None, True)}
    assert recordings.text("é".encode() + b"\xff") == "é�" and recordings.text(3) == "3"
    rows = spark.createDataFrame([("x", {"magnitude": "2.5", "event_time_index": "7", "event_time": "t"}), ("x", {"magnitude": "2.5"}), ("y", {"magnitude": "?"}), ("z", None)], "file string, attrs map<string,string>")
    truth = {r.file: r.truth for r in recordings.ground_truth(recordings.catalogued(rows)).collect()}
    assert truth["x"].magnitude == 2.5 and truth["y"] is None and "z" not in truth
    assert rows.select(recordings.attribute(F.col("attrs"), "none", "default").alias("v")).first().v == "default"
