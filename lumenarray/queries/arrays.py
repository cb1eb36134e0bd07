"""Queries of the waveform, triage, coherence and interferometry operators.

They run on the grid signal that Spark derives from all events; their SQL
builds the same grid and shares its steps as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarray.operators import coherence, injection, interferometry, scoring, triage
from lumenarray.plans import recordings
from lumenarray.sources import waveforms
from lumenarray.session import cut, table


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return waveforms.grid_chunks(table(spark, d, "events"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return waveforms.cells_of(chunks(spark, d))


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def signal_grid(spark, d):
    return cells(spark, d)


def oriented(spark, d):
    return waveforms.oriented(cells(spark, d), "tc")


def cropped(spark, d):
    return waveforms.cropped(cells(spark, d), 2, 9, 20, 100)


def derivative(spark, d):
    return waveforms.derivative(cells(spark, d))


def common_mode(spark, d):
    return _rounded(waveforms.common_mode_removed(cells(spark, d)), "a")


def dead_channels(spark, d):
    low = cells(spark, d).withColumn("a", F.when((F.col("ch") * 7 + F.col("arr")) % 5 == 0, 0).otherwise(F.col("a")))
    return _rounded(waveforms.dead_channels(low), "variance")


def trailing_mean(spark, d):
    return _rounded(triage.trailing_mean(cells(spark, d), 5), "mean").select("arr", "ch", "i", "mean")


def one_bit(spark, d):
    return waveforms.derivative(cells(spark, d)).select("arr", "ch", "i", F.signum("a").cast("int").alias("bit"))


def channel_noise(spark, d):
    rms = cells(spark, d).groupBy("arr", "ch").agg(F.sqrt(F.avg(F.col("a") * F.col("a"))).alias("rms"))
    return _rounded(rms.groupBy("arr").agg(F.median("rms").alias("noise_rms"), F.percentile("rms", F.lit(0.1)).alias("p10"), F.percentile("rms", F.lit(0.9)).alias("p90")), "noise_rms", "p10", "p90")


def smoothed(spark, d):
    return _rounded(interferometry.boxcar(cells(spark, d), 5), "a")


def ratio_of(spark, d):
    return triage.sta_lta(chunks(spark, d))


def fired_of(spark, d, threshold: float = triage.Tier0.threshold):
    """The firing cells, made once: they are few, and every later step reads them."""
    return cut(triage.sta_lta(chunks(spark, d), above=threshold))


def sta_lta(spark, d):
    return _rounded(ratio_of(spark, d), "ratio")


def trigger_raster(spark, d):
    return triage.sta_lta(chunks(spark, d), above=triage.Tier0.threshold).select("arr", "ch", "i")


def merge_runs(spark, d):
    return triage.merge_runs(fired_of(spark, d)).select("arr", "i_from", "i_to")


def density_resegment(spark, d):
    return triage.resegmented(fired_of(spark, d))


def extract_events(spark, d):
    return _rounded(triage.extract_events(fired_of(spark, d)), "peak")


def reduction_stats(spark, d):
    return _rounded(triage.reduction(ratio_of(spark, d)), "flagged_cells", "flagged_time", "silence")


def _parts(spark, d):
    """Chunks, firing cells and events; the last two, small and used by several
    branches of one plan, are made once."""
    fired = fired_of(spark, d)
    return chunks(spark, d), fired, cut(triage.extract_events(fired))


def coincidence(spark, d):
    c, fired, ev = _parts(spark, d)
    return _rounded(coherence.coincidence(ev, fired, c.groupBy("arr").agg(F.count_distinct("ch").alias("n_all"))), "f_c")


def span_fraction(spark, d):
    c, _, ev = _parts(spark, d)
    return _rounded(coherence.span_fraction(ev, c.groupBy("arr").agg(F.count_distinct("ch").alias("n_all"))).select("arr", "event_id", "span"), "span")


def track_speed(spark, d):
    _, fired, ev = _parts(spark, d)
    return _rounded(coherence.track_speed(ev, fired), "speed", "r2", digits=4)


def onset_theil_sen(spark, d):
    _, fired, ev = _parts(spark, d)
    return _rounded(coherence.onset_velocity(ev, fired), "v_onset", "r2")


def semblance_curve(spark, d):
    c, _, ev = _parts(spark, d)
    return _rounded(coherence.semblance(coherence.stacked(ev, c)), "p", "semblance")


def velocity_peak(spark, d):
    c, _, ev = _parts(spark, d)
    return _rounded(coherence.stacked(ev, c).select("arr", "event_id", "k", "p", "semblance", "boundary", "v"), "p", "semblance", "v")


def coherent_channels(spark, d):
    c, _, ev = _parts(spark, d)
    return coherence.stacked(ev, c).select("arr", "event_id", "n_coherent")


def verdicts(spark, d):
    c, fired, ev = _parts(spark, d)
    v = coherence.verdicts(coherence.measured(ev, c, fired))
    return _rounded(v, "v", "semblance", "f_c", "span", "speed", "v_onset", digits=4).drop("explanations", "boundary", "r2", "onset_r2", "t_p", "t_s")


def observed_snr(spark, d):
    c, _, ev = _parts(spark, d)
    return _rounded(coherence.observed_snr(ev, c), "snr")


def injected_waves(spark, d):
    return injection.injected(cells(spark, d)).select("arr", "ch", "i", "a")


def injected_recall(spark, d):
    return _rounded(injection.recall_curve(cells(spark, d)), "recall", "low", "high")


def _recordings(spark, d):
    """The grid as recordings: three samples a second, 1,500 m between channels.
    A third of them is catalogued with an origin, a third without."""
    c = cut(chunks(spark, d))
    arr = F.col("arr")
    one = c.groupBy("arr").agg(F.count_distinct("ch").alias("n_ch"))
    geometry = one.select("arr", F.lit(3.0).alias("fs"), F.lit(1500.0).alias("dx"), F.lit(15).alias("n_ch"), F.lit(4.0).alias("threshold"))
    truth = one.select("arr", F.when(arr % 3 != 0, 1.0 + arr % 5).alias("magnitude"), F.when(arr % 3 == 1, 12.0 + (arr * 13) % 10).alias("origin_s"), F.lit(None).cast("double").alias("distance_km"))
    return c, geometry, truth


def file_verdicts(spark, d):
    """Every event of every recording with its verdict in physical units."""
    c, geometry, _ = _recordings(spark, d)
    return recordings.analysed(c, geometry)


def file_ledger(spark, d):
    """The ledger row of every recording."""
    return recordings.ledger_rows(*_recordings(spark, d))


def threshold_sweep(spark, d):
    return recordings.threshold_sweep(*_recordings(spark, d), (4.0, 5.0, 7.0))


def threshold_scores(spark, d):
    """The sweep's other thresholds against the one in force."""
    s = cut(threshold_sweep(spark, d))
    return scoring.sweep_scores(s.filter("candidate <> 4.0").drop("classification"), s.filter("candidate = 4.0").select("array", "event_file", "outcome"))


def event_gathers(spark, d):
    """Gathers of the events tracked as moving sources, in units of the grid."""
    c, fired, ev = _parts(spark, d)
    return _rounded(interferometry.gather_of_events(ev.filter("n_ch > 3 and i_to - i_from >= 3"), waveforms.cells_of(c), lags=6, window=16, hop=8, pad=8), "ncf")


def event_windows(spark, d):
    c, _, ev = _parts(spark, d)
    w = coherence.event_window(ev, c)
    return w.groupBy("arr", "event_id").agg(F.count("*").alias("n"), F.sum("a").alias("total"), F.max("x").alias("last_x"))


def concatenated(spark, d):
    two = cells(spark, d).select(F.expr("arr div 2").alias("arr"), "ch", "i", "a", F.concat(F.lit("f"), F.col("arr") % 2).alias("file"))
    return waveforms.concatenated(two)


def one_bit_xcorr(spark, d):
    return _rounded(interferometry.gather(cells(spark, d), ref=7, lags=6, window=40, hop=20), "ncf")


def fold_and_fit(spark, d):
    return _rounded(interferometry.group_velocity(interferometry.gather(cells(spark, d), ref=7, lags=6, window=40, hop=20), ref=7), "velocity", "r2", digits=4)


def sliding_windows(spark, d):
    return interferometry.windows(cells(spark, d), window=40, hop=20).groupBy("arr", "win").agg(F.count("*").alias("n"), F.min("i").alias("i_from"), F.max("i").alias("i_to"))


QUERIES = {f.__name__: f for f in (
    signal_grid, oriented, cropped, derivative, common_mode, dead_channels, trailing_mean, one_bit, channel_noise, smoothed, sta_lta, trigger_raster, merge_runs, density_resegment, extract_events, reduction_stats,
    coincidence, span_fraction, track_speed, onset_theil_sen, semblance_curve, velocity_peak, coherent_channels, verdicts, observed_snr, injected_waves, injected_recall, file_verdicts, file_ledger, threshold_sweep, threshold_scores, event_gathers, event_windows, concatenated, one_bit_xcorr, fold_and_fit, sliding_windows,
)}

GRID = """
happened as (select user_id, value, cast(floor(epoch(ts) / 21600.0) as bigint) as bin from events where user_id is not null and ts is not null),
lim as (select min(bin) as lo, max(bin) as hi from happened),
sums as (select user_id, cast(bin - lo as int) as i, cast(coalesce(sum(cast(round(value * 100) as bigint)), 0) as bigint) as v from happened, lim group by all),
cells as (select u.user_id // 15 as arr, cast(u.user_id % 15 as int) as ch, cast(r.i as int) as i, coalesce(s.v, 0) as a from (select distinct user_id from happened) u cross join (select unnest(range(0, hi - lo + 1)) as i from lim) r left join sums s on s.user_id = u.user_id and s.i = r.i)
"""
_SNR = "levels(k, snr) as (values (0, 1.0), (1, 2.0), (2, 3.0), (3, 5.0), (4, 8.0), (5, 12.0), (6, 20.0)), wav(j, w) as (values (0, 1), (1, 2), (2, -3), (3, 5), (4, -3), (5, 2), (6, 1))"
INJECTED = GRID.replace("cells as (", "base as (") + f""",
{_SNR},
noise as (select arr, median(rms) as noise from (select arr, ch, sqrt(avg(a * a)) as rms from base group by all) group by arr),
trials as (select arr, k, snr::double as snr, 40 + (arr * 13 + k * 5) % 60 as t0, noise from noise cross join levels),
cells as (select t.arr * 7 + t.k as arr, b.ch, b.i, b.a + coalesce(cast(round(t.snr * t.noise / sqrt(53 / 7.0::double) * w.w) as bigint), 0) as a from base b join trials t on t.arr = b.arr left join wav w on w.j = b.i - t.t0 - b.ch)
"""
RATIO = GRID + """,
run as (select *, cast(sum(a * a) over (partition by arr, ch order by i) as double) as c from cells),
backs as (select *, coalesce(lag(c, 3) over w, 0) as c3, coalesce(lag(c, 5) over w, 0) as c5, coalesce(lag(c, 29) over w, 0) as c29 from run window w as (partition by arr, ch order by i)),
greatest_size as (select arr, cast(max(abs(a)) as double) as m from cells group by arr),
ratio as (select arr, ch, i, case when i < 29 or m = 0 then 1.0 else ((c - c3) / 3) / ((c5 - c29) / 24 + 1e-12 * m * m) end as ratio from backs join greatest_size using (arr)),
fired as (select * from ratio where ratio > 4)
"""
SEGMENTS = RATIO + """,
times as (select arr, i, count(distinct ch) as n from fired group by all),
numbered as (select *, sum(new) over (partition by arr order by i) as run from (select *, case when i - lag(i) over (partition by arr order by i) - 1 > 1 then 1 else 0 end as new from times)),
runs as (select arr, run, min(i) as i_from, max(i) as i_to from numbered group by all),
inside as (select t.arr, r.run, t.i from times t join runs r on t.arr = r.arr and t.i between r.i_from and r.i_to where r.i_to - r.i_from + 1 > 12 and t.n >= 2),
parts as (select arr, run, part, min(i) as i_from, max(i) as i_to from (select *, sum(new) over (partition by arr, run order by i) as part from (select *, case when i - lag(i) over (partition by arr, run order by i) - 1 > 1 then 1 else 0 end as new from inside)) group by all),
segs as (select arr, i_from, i_to, cast(row_number() over (partition by arr order by i_from) - 1 as int) as seg from (
  select arr, i_from, i_to from runs r where i_to - i_from + 1 <= 12 or not exists (select 1 from parts p where p.arr = r.arr and p.run = r.run)
  union all select arr, i_from, i_to from parts))
"""
EVENTS = SEGMENTS + """,
hit as (select f.arr, s.seg, s.i_from as seg_from, f.ch, f.i, f.ratio from fired f join segs s on f.arr = s.arr and f.i between s.i_from and s.i_to where s.i_to - s.i_from + 1 >= 2),
grps as (select *, cast(sum(new) over (partition by arr, seg order by ch) as int) as grp from (select *, case when ch - lag(ch) over (partition by arr, seg order by ch) > 3 then 1 else 0 end as new from (select distinct arr, seg, ch from hit))),
ngrp as (select arr, seg, max(grp) + 1 as n_grp from grps group by all),
evts as (select arr, 'evt_' || lpad(cast(seg as varchar), 4, '0') || '_' || seg_from || case when n_grp > 1 then '_' || grp else '' end as event_id, min(i) as i_from, max(i) as i_to, min(ch) as ch_min, max(ch) as ch_max, count(distinct ch) as n_ch, max(ratio) as peak
  from hit join grps using (arr, seg, ch) join ngrp using (arr, seg) group by arr, seg, seg_from, grp, n_grp having max(i) - min(i) + 1 >= 2),
nall as (select arr, count(distinct ch) as n_all from cells group by all)
"""
_KERNEL = "case when {m} = 0 then 0 else (cos(pi() * {m} / {n}) - case when {n} % 2 = 0 then cos(pi() * {m}) * cos(pi() * {m} / {n}) else cos(pi() * {m}) end) / sin(pi() * {m} / {n}) / {n} end"
WINDOWS = EVENTS + """,
ends as (select arr, max(i) as last_i from cells group by arr),
spans as (select *, cast(ceil(3.0 * (ch_max - ch_min)) as int) + 6 as margin from evts),
bounds as (select s.*, greatest(i_from - margin, 0) as lo, least(i_to + margin, last_i) as hi from spans s join ends using (arr)),
sized as (select *, hi - lo + 1 as n, greatest(1, least(margin, (hi - lo + 1 - 3) // 2)) as eff from bounds),
win as (select e.arr, e.event_id, e.lo, e.hi, e.n, e.eff, c.ch - e.ch_min as x, c.i, c.a from sized e join cells c on e.arr = c.arr and c.ch between e.ch_min and e.ch_max and c.i between e.lo and e.hi)
"""
CURVE = WINDOWS + """,
steps as (select range as j from range(36)),
slow as (select j as k, -1 / (1 / 3.0::double * power(6.0::double, j / 35.0)) as p from steps union all select 71 - j, 1 / (1 / 3.0::double * power(6.0::double, j / 35.0)) from steps),
env as (select t.arr, t.event_id, t.lo, t.hi, t.n, t.eff, t.x, t.i, sqrt(power(any_value(t.a), 2) + power(sum(u.a * (""" + _KERNEL.format(m="(t.i - u.i)::double", n="t.n") + """)), 2)) as e
  from win t join win u on t.arr = u.arr and t.event_id = u.event_id and t.x = u.x group by all),
centred as (select *, e - avg(case when i between lo + eff and hi - eff then e end) over (partition by arr, event_id, x) as g from env),
places as (select c.arr, c.event_id, c.x, c.i as t, s.k, s.p, least(greatest(c.i + cast(round_even(s.p * c.x, 0) as int), c.lo), c.hi) as j from centred c cross join slow s where c.i between c.lo + c.eff and c.hi - c.eff),
shifted as (select p.*, c.g, c.e from places p join centred c on p.arr = c.arr and p.event_id = c.event_id and p.x = c.x and p.j = c.i),
curve as (select arr, event_id, k, p, sum(s * s) / (max(n) * sum(q) + 1e-20) as semblance from (select arr, event_id, k, p, t, sum(g) as s, sum(g * g) as q, count(*) as n from shifted group by all) group by all),
peaks as (
  select arr, event_id, k, p, least(1.0, greatest(0.0, s)) as semblance, coalesce(not (s > l and s > r), true) as boundary, 1 / p as v from (
    select *, lag(s) over b as l, lead(s) over b as r, row_number() over (partition by arr, event_id order by s desc, k) as best from (select *, round(semblance, 9) as s from curve) window b as (partition by arr, event_id, sign(p) order by k)) where best = 1),
core as (select arr, event_id, x, t, e - avg(e) over (partition by arr, event_id, x) as g from shifted join peaks using (arr, event_id, k)),
beam as (select arr, event_id, t, avg(g) as b from core group by all),
corr as (select arr, event_id, x, sum(g * b) / ((sqrt(sum(g * g)) + 1e-12) * (sqrt(sum(b * b)) + 1e-12)) as r from core join beam using (arr, event_id, t) group by all),
coh as (select arr, event_id, cast(sum(case when round(r, 9) > 0.3 then 1 else 0 end) as bigint) as n_coherent from corr group by all)
"""
TRACK = """,
tw as (select e.arr, e.event_id, r.i, sum(ratio - 4) as w, sum((ratio - 4) * ch) / sum(ratio - 4) as c from evts e join ratio r on e.arr = r.arr and r.i between e.i_from and e.i_to and r.ch between e.ch_min - 5 and e.ch_max + 5 where ratio > 4 group by all),
tf as (select arr, event_id, count(*) as n, sum(w*w) as s, sum(w*w*i) as sx, sum(w*w*c) as sy, sum(w*w*i*i) as sxx, sum(w*w*i*c) as sxy, sum(w*c) / sum(w) as mean from tw group by all having count(*) >= 5),
tl as (select *, (s*sxy - sx*sy) / (s*sxx - sx*sx) as speed from tf where s*sxx - sx*sx <> 0),
track as (select arr, event_id, speed, greatest(0.0, 1 - sum(w * power(c - speed * i - (sy - speed * sx) / s, 2)) / (sum(w * power(c - mean, 2)) + 1e-12)) as r2 from tw join tl using (arr, event_id) group by arr, event_id, speed),
firsts as (select e.arr, e.event_id, f.ch, min(f.i) as t from evts e join fired f on e.arr = f.arr and f.i between e.i_from and e.i_to and f.ch between e.ch_min and e.ch_max group by all),
fx as (select arr, event_id, count(*) as n, median(ch) as mx, median(t) as my, avg(t) as mean from firsts group by all having count(*) >= 4),
sl as (select a.arr, a.event_id, median((b.t - a.t) / (b.ch - a.ch)) as slope from firsts a join firsts b on a.arr = b.arr and a.event_id = b.event_id and a.ch < b.ch group by all),
onset as (select arr, event_id, case when abs(slope) < 1e-9 then cast('inf' as double) else 1 / slope end as v_onset, greatest(0.0, 1 - sum(power(t - slope * ch - (my - slope * mx), 2)) / (sum(power(t - mean, 2)) + 1e-12)) as r2 from firsts join fx using (arr, event_id) join sl using (arr, event_id) group by arr, event_id, slope),
allfirst as (select e.arr, e.event_id, f.ch, min(f.i) as first from evts e join fired f on e.arr = f.arr and f.i between e.i_from and e.i_to group by all),
coin as (select arr, event_id, max(m) / cast(greatest(count(*), 10, floor(max(n_all) * 0.05)) as double) as f_c from (select *, count(*) over (partition by arr, event_id order by first range between 4 preceding and current row) as m from allfirst) join nall using (arr) group by all)
"""

WILSON_LOW = "case when {n} = 0 then 0 else greatest(0, ({k}/{n} + 3.841458820694124/(2*{n}) - 1.959963984540054*sqrt({k}/{n}*(1-{k}/{n})/{n} + 3.841458820694124/(4*{n}*{n}))) / (1 + 3.841458820694124/{n})) end"
WILSON_HIGH = "case when {n} = 0 then 1 else least(1, ({k}/{n} + 3.841458820694124/(2*{n}) + 1.959963984540054*sqrt({k}/{n}*(1-{k}/{n})/{n} + 3.841458820694124/(4*{n}*{n}))) / (1 + 3.841458820694124/{n})) end"

_WINS = ", wins as (select arr, unnest(range(0, cast(floor((max(i) + 1 - 40) / 20.0) as bigint) + 1)) as w from cells group by arr)"
SQL = {
    "signal_grid": f"with {GRID} select * from cells",
    "oriented": f"with {GRID} select arr, i as ch, ch as i, a from cells",
    "cropped": f"with {GRID} select * from cells where ch between 2 and 9 and i between 20 and 99",
    "derivative": f"with {GRID} select * from (select arr, ch, i, cast(lead(a) over (partition by arr, ch order by i) - a as double) as a from cells) where a is not null",
    "common_mode": f"with {GRID} select arr, ch, i, round(a - median(a) over (partition by arr, i), 6) as a from cells",
    "dead_channels": f"with {GRID}, v as (select arr, ch, var_pop(case when (ch * 7 + arr) % 5 = 0 then 0 else a end) as v from cells group by all), m as (select arr, greatest(1.0, median(v)) as m from v group by all) select arr, ch, round(v, 6) as variance from v join m using (arr) where v < 1e-12 * m",
    "trailing_mean": f"with {GRID} select arr, ch, i, round(avg(a) over (partition by arr, ch order by i rows 4 preceding), 6) as mean from cells",
    "one_bit": f"with {GRID} select * from (select arr, ch, i, cast(sign(lead(a) over (partition by arr, ch order by i) - a) as int) as bit from cells) where bit is not null",
    "channel_noise": f"with {GRID}, r as (select arr, ch, sqrt(avg(a * a)) as rms from cells group by all) select arr, round(median(rms), 6) as noise_rms, round(quantile_cont(rms, 0.1), 6) as p10, round(quantile_cont(rms, 0.9), 6) as p90 from r group by all",
    "smoothed": f"with {GRID} select arr, ch, i, round(sum(a) over (partition by arr, ch order by i rows between 2 preceding and 2 following) / 5.0, 6) as a from cells",
    "sta_lta": f"with {RATIO} select arr, ch, i, round(ratio, 6) as ratio from ratio",
    "trigger_raster": f"with {RATIO} select arr, ch, i from fired",
    "merge_runs": f"with {SEGMENTS} select arr, i_from, i_to from runs",
    "density_resegment": f"with {SEGMENTS} select * from segs",
    "extract_events": f"with {EVENTS} select * replace (round(peak, 6) as peak) from evts",
    "reduction_stats": f"with {RATIO}, p as (select arr, i, count(*) as n, count_if(ratio > 4) as f from ratio group by all) select arr, round(sum(f) / sum(n), 6) as flagged_cells, round(count_if(f > 0) / count(*), 6) as flagged_time, round(1 - count_if(f > 0) / count(*), 6) as silence from p group by all",
    "coincidence": f"with {EVENTS} {TRACK} select arr, event_id, round(f_c, 6) as f_c from coin",
    "span_fraction": f"with {EVENTS} select arr, event_id, round((ch_max - ch_min + 1) / n_all, 6) as span from evts join nall using (arr)",
    "track_speed": f"with {EVENTS} {TRACK} select arr, event_id, round(speed, 4) as speed, round(r2, 4) as r2 from track",
    "onset_theil_sen": f"with {EVENTS} {TRACK} select arr, event_id, round(v_onset, 6) as v_onset, round(r2, 6) as r2 from onset",
    "semblance_curve": f"with {CURVE} select arr, event_id, k, round(p, 6) as p, round(semblance, 6) as semblance from curve",
    "velocity_peak": f"with {CURVE} select arr, event_id, k, round(p, 6) as p, round(semblance, 6) as semblance, boundary, round(v, 6) as v from peaks",
    "coherent_channels": f"with {CURVE} select * from coh",
    "verdicts": f"with {CURVE} {TRACK}" + """,
m as (select e.arr, e.event_id, e.n_ch, (e.ch_max - e.ch_min + 1) / n_all as span, f_c, p.v, p.semblance, p.boundary, o.v_onset, t.speed, t.r2, c.n_coherent, e.i_to - e.i_from + 1 as dur
  from evts e join nall using (arr) left join coin using (arr, event_id) left join peaks p on p.arr = e.arr and p.event_id = e.event_id and e.n_ch > 3 left join coh c on c.arr = e.arr and c.event_id = e.event_id and e.n_ch > 3
  left join track t on t.arr = e.arr and t.event_id = e.event_id and e.n_ch > 3 left join onset o on o.arr = e.arr and o.event_id = e.event_id and e.n_ch > 3),
j as (select *, case when n_ch <= 3 then 'INCOHERENTE_LOCAL_SUPRIMIDO'
  when f_c >= 0.3 and span >= 0.3 and not boundary and semblance >= 0.12 and abs(v) between 1/3.0 and 2 and not isinf(v_onset) and abs(abs(v) - abs(v_onset)) <= 0.4 * (abs(v) + abs(v_onset)) / 2 then 'SISMO_CONFIRMADO'
  when abs(speed) between 0.05 and 2 and r2 >= 0.8 and dur >= 3 then 'FUENTE_MOVIL_TRAFICO'
  when f_c >= 0.5 and span >= 0.5 then 'POSIBLE_REGIONAL_EMERGENTE'
  when coalesce(n_coherent, 0) <= 3 and coalesce(semblance, 0) < 0.12 and f_c < 0.5 and span < 0.5 then 'INCOHERENTE_LOCAL_SUPRIMIDO' else 'COHERENTE_DESCONOCIDO' end as classification from m)
select arr, event_id, classification, case when classification <> 'INCOHERENTE_LOCAL_SUPRIMIDO' then round(v, 4) end as v, round(semblance, 4) as semblance, round(f_c, 4) as f_c, round(span, 4) as span, n_coherent,
  case when classification not in ('INCOHERENTE_LOCAL_SUPRIMIDO', 'SISMO_CONFIRMADO') then round(speed, 4) end as speed, round(v_onset, 4) as v_onset, classification = 'INCOHERENTE_LOCAL_SUPRIMIDO' as suppressed from j""",
    "observed_snr": f"with {EVENTS}" + """, per as (select e.arr, e.event_id, c.ch, sqrt(avg(case when c.i between e.i_from and e.i_to then c.a * c.a end)) as s, sqrt(avg(case when c.i < e.i_from - 2 then c.a * c.a end)) as n from evts e join cells c on c.arr = e.arr and c.ch between e.ch_min and e.ch_max where e.i_from >= 4 group by all)
select arr, event_id, round(median(s) / median(n), 6) as snr from per group by all having median(n) > 0""",
    "injected_waves": f"with {INJECTED} select * from cells",
    "injected_recall": "with " + EVENTS.replace(GRID, INJECTED) + ", res as (select t.k, t.snr, count(*) as n, count_if(exists (select 1 from evts e where e.arr = t.arr * 7 + t.k and t.t0 between e.i_from - 3 and e.i_to + 3)) as hits from trials t group by all) select snr, n, hits, round(hits / n, 6) as recall, round(" + WILSON_LOW.format(k="hits", n="n") + ", 6) as low, round(" + WILSON_HIGH.format(k="hits", n="n") + ", 6) as high from res",
    "event_windows": f"with {WINDOWS} select arr, event_id, count(*) as n, cast(sum(a) as bigint) as total, max(x) as last_x from win group by all",
    "concatenated": f"with {GRID}, two as (select arr // 2 as arr, ch, i, a, arr % 2 as f from cells), len as (select arr, f, max(i) + 1 as n from two group by all), off as (select arr, f, coalesce(sum(n) over (partition by arr order by f rows between unbounded preceding and 1 preceding), 0) as o from len) select arr, ch, cast(i + o as bigint) as i, a from two join off using (arr, f)",
    "sliding_windows": f"with {GRID} {_WINS} select c.arr, cast(w as int) as win, count(*) as n, min(i) as i_from, max(i) as i_to from cells c join wins on wins.arr = c.arr and i between w * 20 and w * 20 + 39 group by all",
}
_GATHER = _WINS + """,
bits as (select c.arr, ch, i, sign(a) as b, w from cells c join wins on wins.arr = c.arr and i between w * 20 and w * 20 + 39),
dm as (select arr, w, ch, i, b - avg(b) over (partition by arr, w, ch) as y from bits),
nm as (select arr, w, ch, i, y / (sqrt(sum(y * y) over (partition by arr, w, ch)) + 1e-12) as y from dm),
nwin as (select arr, count(*) as n from wins group by arr),
ncf as (select c.arr, c.ch, l.lag, sum(r.y * c.y) / any_value(n) as ncf from (select range as lag from range(-6, 7)) l join nm r on r.ch = 7 join nm c on c.arr = r.arr and c.w = r.w and c.i = r.i + l.lag join nwin on nwin.arr = c.arr group by all)
"""
SQL["one_bit_xcorr"] = f"with {GRID} {_GATHER} select arr, ch, cast(lag as int) as lag, round(ncf, 6) as ncf from ncf"
SQL["fold_and_fit"] = f"with {GRID} {_GATHER}" + """,
folded as (select a.arr, a.ch, a.lag, (a.ncf + b.ncf) / 2 as f from ncf a join ncf b on a.arr = b.arr and a.ch = b.ch and b.lag = -a.lag where a.lag >= 0),
env as (select t.arr, t.ch, t.lag, round(sqrt(power(any_value(t.f), 2) + power(sum(u.f * (""" + _KERNEL.format(m="(t.lag - u.lag)::double", n="7") + """)), 2)), 9) as e from folded t join folded u on t.arr = u.arr and t.ch = u.ch group by all),
reach as (select *, abs(ch - 7) as o, greatest(0, floor(abs(ch - 7) / 4.0)) as ka, least(6, ceil(abs(ch - 7) / 0.5)) as kb from env where abs(ch - 7) between 1 and 7),
best as (select arr, ch, o, lag as t, e as w from (select *, row_number() over (partition by arr, ch order by e desc, lag) as k from reach where kb - ka >= 2 and lag between ka and kb) where k = 1),
fit as (select arr, sum(w * o * t) / (sum(w * t * t) + 1e-12) as v, sum(w * t) / sum(w) as m from best group by all having count(*) >= 8 and max(t) > 0)
select arr, round(v, 4) as velocity, round(greatest(0.0, 1 - sum(w * power(t - o / greatest(v, 1e-9), 2)) / (sum(w * power(t - m, 2)) + 1e-12)), 4) as r2 from best join fit using (arr) group by arr, v, m"""
