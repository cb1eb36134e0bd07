"""Queries of the ledger, profile, catalogue, scoring and calibration operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenarray.functions.files import current, file_start_s, with_array
from lumenarray.operators import catalog, scoring
from lumenarray.queries.arrays import WILSON_HIGH, WILSON_LOW
from lumenarray.queries.problems import NOW
from lumenarray.session import table
from lumenarray.sources import waveforms

BOUNDS = (0.05, 0.08, 0.12, 0.2, 0.35)


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def ledger_latest(spark, d):
    return current(table(spark, d, "ledger"), "verdict", "outcome", "ts")


def ledger_decoded(spark, d):
    return catalog.decoded(table(spark, d, "ledger")).select("event_file", "magnitude", "distance_km", "semblance", "n_candidates", "origin_ms")


def ledger_invalidated(spark, d):
    largest = table(spark, d, "arrays").filter("n_ch >= 2000")
    return catalog.invalidated(table(spark, d, "ledger"), largest, "geometry revised").groupBy("array_id", "reason").agg(F.count("*").alias("n"))


def profile_merge(spark, d):
    return catalog.merged_profiles(table(spark, d, "array_profiles")).select("array_id", "updated", "fs", "dx", "n_ch", "aperture_m", "synth_recall", "snr50")


def profile_config(spark, d):
    return catalog.configured(catalog.merged_profiles(table(spark, d, "array_profiles")), table(spark, d, "arrays"))


def profile_archive(spark, d):
    return catalog.archived(table(spark, d, "array_profiles"), "before a new write")


def resolvable_speed(spark, d):
    p = table(spark, d, "array_profiles").filter("aperture_m is not null and fs is not null").select("array_id", "aperture_m", "fs").distinct()
    return _r(p.select("array_id", "aperture_m", "fs", (F.col("aperture_m") * F.col("fs") / 3).alias("v_max")), "v_max", digits=4)


def nearest_prototype(spark, d):
    e = table(spark, d, "embeddings")
    return _r(catalog.nearest_prototype(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), catalog.prototypes(e, "label", "embedding", 64), 0.3), "similarity")


def promote(spark, d):
    c = table(spark, d, "unknown_clusters").filter("id is not null").groupBy("id").agg(F.max("n_events").alias("n_events"), F.min("array_id").alias("array_id"))
    return catalog.promoted(c, 5, F.col("array_id"))


def unpromoted(spark, d):
    c = table(spark, d, "unknown_clusters").filter("id is not null").groupBy("id").agg(F.max("n_events").alias("n_events"), F.min("array_id").alias("array_id"))
    return catalog.remaining(c, catalog.promoted(c, 5, F.col("array_id")))


def _candidates(spark, d):
    return scoring.candidates(catalog.decoded(table(spark, d, "ledger")), table(spark, d, "resultados"), table(spark, d, "arrays"))


def causal_match(spark, d):
    return _candidates(spark, d).select("event_file", "file", "event_id", "classification", "channels", "at_ms")


def best_candidate(spark, d):
    return _r(scoring.best_candidates(_candidates(spark, d)), "delay_s")


def outcome_per_file_whole(spark, d):
    """Truth without an origin is answered by the verdict with most channels of its file."""
    truth = catalog.decoded(table(spark, d, "ledger"))
    best = scoring.best_candidates(_candidates(spark, d)).select("event_file", "classification")
    return scoring.outcomes(truth, best.unionByName(scoring.loudest(truth, table(spark, d, "resultados")).select("event_file", "classification")))


def outcome_per_file(spark, d):
    return outcome_per_file_whole(spark, d)


def outcome_matrix(spark, d):
    return _r(scoring.outcome_matrix(catalog.decoded(table(spark, d, "ledger"))), "rate", "low", "high")


def array_outcomes(spark, d):
    now = with_array(current(table(spark, d, "ledger"), "outcome"), table(spark, d, "arrays"))
    return now.rollup("array", "outcome").agg(F.count("*").alias("n"))


def stale_hits(spark, d):
    now = catalog.decoded(table(spark, d, "ledger"))
    return now.filter("outcome = 'HIT' and boundary_pinned is null").select("event_file")


def delay_anomalies(spark, d):
    now = with_array(current(table(spark, d, "ledger"), "dt_detect_s"), table(spark, d, "arrays"))
    return scoring.repeated_delays(now.select("array", F.col("dt_detect_s").alias("delay")))


def detectability(spark, d):
    now = with_array(catalog.decoded(table(spark, d, "ledger")).filter("magnitude is not null"), table(spark, d, "arrays"))
    p = catalog.merged_profiles(table(spark, d, "array_profiles")).select(F.col("array_id").alias("array"), F.col("aperture_m").alias("profile_aperture"))
    a = table(spark, d, "arrays").select(F.col("array_id").alias("array"), "aperture_m")
    return now.join(p, "array", "left").join(a, "array", "left").select("event_file", "magnitude", "distance_km", F.coalesce("profile_aperture", "aperture_m").alias("aperture_m"), "outcome")


def calibration_flips(spark, d):
    return scoring.calibration_flips(catalog.decoded(table(spark, d, "ledger")), BOUNDS)


def _decoded_arrays(spark, d):
    return with_array(catalog.decoded(table(spark, d, "ledger")), table(spark, d, "arrays"))


def calibration_choice(spark, d):
    return scoring.calibration_choice(scoring.calibration_flips(_decoded_arrays(spark, d), BOUNDS, ("array",)), BOUNDS, ("array",))


def calibration_score(spark, d):
    """Candidates for the least semblance against the outcomes on record."""
    rows = _decoded_arrays(spark, d)
    return scoring.sweep_scores(scoring.calibration_outcomes(rows, BOUNDS), rows.select("array", "event_file", "outcome"))


def calibration_proposals(spark, d):
    now = catalog.configured(catalog.merged_profiles(table(spark, d, "array_profiles")), table(spark, d, "arrays")).withColumnRenamed("array_id", "array")
    return scoring.proposals(calibration_score(spark, d), now, "seismic_min_semblance", F.col("min_semblance"))


def calibration_applied(spark, d):
    """The profiles after the proposals: which bound each array has."""
    p = catalog.merged_profiles(table(spark, d, "array_profiles")).select("array_id", "thresholds_json")
    after = scoring.applied(p, calibration_proposals(spark, d), "seismic_min_semblance")
    return after.select("array_id", F.get_json_object("thresholds_json", "$.seismic_min_semblance").try_cast("double").alias("min_semblance"))


def pipeline_margin(spark, d):
    return _r(table(spark, d, "arrays").select("array_id", scoring.pipeline_margin(F.col("aperture_m")).alias("margin_s")), "margin_s")


def scoped_match(spark, d):
    """Signatures against the prototypes of their own array, and the prototypes'
    counts of events afterwards."""
    c = table(spark, d, "unknown_clusters").filter("id is not null and size(vec) = 64 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(vec, x -> x <> 0)")
    one = c.groupBy("id").agg(F.max_by(F.struct("n_events", "array_id", "vec"), F.struct("n_events", F.coalesce("last_seen", F.lit(float("-inf"))), "array_id", "vec")).alias("r")).select("id", "r.*")
    protos = catalog.promoted(one, 5, F.col("array_id")).withColumn("array_id", F.col("label"))
    got = catalog.nearest_prototype(one.select("id", "vec", "array_id"), protos.select("label", F.col("vec").alias("proto"), "array_id"), 0.85, "array_id")
    return catalog.recounted(protos.select("label", "id", "n_events"), got)


def recall_overlay(spark, d):
    return scoring.overlay(table(spark, d, "ledger"), table(spark, d, "arrays"))


def quiet_stretches(spark, d):
    """Of each recording with verdicts, the stretches away from its origin."""
    long = table(spark, d, "resultados").filter("file is not null and time_offset_s is not null and not isnan(time_offset_s)").groupBy("file").agg(F.max("time_offset_s").alias("length_s"))
    at = catalog.decoded(table(spark, d, "ledger")).select(F.col("event_file").alias("file"), (F.col("origin_ms") / 1000 - file_start_s(F.col("event_file"))).alias("origin_s"))
    return _r(waveforms.quiet_stretches(long.join(at, "file", "left")), "from_s", "to_s", digits=3)


def recall_gauge(spark, d):
    now = with_array(current(table(spark, d, "ledger"), "outcome"), table(spark, d, "arrays"))
    return _r(now.filter("outcome in ('HIT', 'HONEST_UNKNOWN', 'HONEST_REGIONAL', 'MISS_SUPPRESSED', 'MISS_BELOW_FLOOR')").groupBy("array").agg(F.avg((F.col("outcome") == "HIT").cast("int")).alias("recall"), F.count("*").alias("n")), "recall")


def recall_curves(spark, d):
    s = scoring.curves(table(spark, d, "array_profiles"))
    low, high = scoring.wilson(F.col("hits"), F.col("n"))
    return _r(s.withColumn("low", low).withColumn("high", high), "low", "high")


def snr50(spark, d):
    return _r(scoring.snr50(scoring.curves(table(spark, d, "array_profiles"))), "snr50")


def recall_falls(spark, d):
    return scoring.falling(scoring.curves(table(spark, d, "array_profiles")))


QUERIES = {f.__name__: f for f in (
    ledger_latest, ledger_decoded, ledger_invalidated, profile_merge, profile_config, profile_archive, resolvable_speed, nearest_prototype, promote, unpromoted, causal_match, best_candidate, outcome_per_file, outcome_per_file_whole,
    outcome_matrix, array_outcomes, stale_hits, delay_anomalies, detectability, calibration_flips, calibration_choice, calibration_proposals, calibration_applied, pipeline_margin, scoped_match, recall_overlay, quiet_stretches, calibration_score, recall_gauge, recall_curves, snr50, recall_falls,
)}

DECODED = NOW + """,
j1 as (select event_file, arr, verdict, outcome, ts, dt_detect_s, case when json_valid(trim(gt_json)) then trim(gt_json) end as g, case when json_valid(trim(metrics_json)) then trim(metrics_json) end as m from timed),
j2 as (select * replace (case when g like '"%' then g->>'$' else g end as g, case when m like '"%' then m->>'$' else m end as m) from j1),
j3 as (select * replace (case when json_valid(g) then g end as g, case when json_valid(m) then m end as m) from j2),
truth as (
  select *, try_cast(g->>'magnitude' as double) as magnitude, try_cast(g->>'distance_km' as double) as distance_km, nullif(g->>'origin_time', '') as o,
    try_cast(m->>'semblance' as double) as semblance, try_cast(m->>'coincidence_fraction' as double) as f, try_cast(m->>'span_fraction' as double) as s, try_cast(m->>'apparent_velocity_mps' as double) as v, try_cast(m->>'n_candidates_causal_window' as bigint) as n_candidates, m->>'boundary_pinned' as pinned from j3),
dec as (select *, case when regexp_full_match(o, '-?[0-9]+([.][0-9]+)?') then cast(round(cast(o as double) * 1000) as bigint)
    else epoch_ms(try_cast(replace(replace(o, '/', '-'), ',', '.') || case when regexp_matches(o, 'T.*(Z|[+-][0-9]{2}:?[0-9]{2})$') then '' else '+00' end as timestamptz)) end as origin_ms from truth)
"""
VERDICT_TIMES = DECODED + """,
vs as (select r.file, r.event_id, r.classification, coalesce(r.coherent_channels, 0) as channels, a.array_id as arr, r.time_offset_s, regexp_extract(r.file, '[_-]([^_-]*(?:-[0-9]{2}-[0-9]{2}_[0-9.]+)?)[.]h5$', 1) as mark from resultados r join arrays a on starts_with(r.file, a.file_prefix || '_') or starts_with(r.file, a.file_prefix || '-') where time_offset_s is not null and not isnan(time_offset_s)),
vt as (select *, cast(round((case when mark like '%T%Z' then epoch(strptime(mark, '%Y%m%dT%H%M%SZ')) when mark like '%-%' then epoch(strptime(mark, '%Y-%m-%d_%H.%M.%S')) else cast(mark as double) end + time_offset_s) * 1000) as bigint) as at_ms from vs)
"""
CAUSAL = VERDICT_TIMES + """,
cand as (select distinct d.event_file, d.origin_ms, x.file, x.event_id, x.classification, x.channels, x.at_ms from dec d join vt x on d.arr = x.arr and x.at_ms between d.origin_ms and d.origin_ms + cast(round(coalesce(d.distance_km * 1000 / 2000 + 5, 60) * 1000) as bigint)),
best as (select * from (select *, row_number() over (partition by event_file order by case classification when 'SISMO_CONFIRMADO' then 1 when 'POSIBLE_REGIONAL_EMERGENTE' then 2 when 'FUENTE_MOVIL_TRAFICO' then 3 when 'COHERENTE_DESCONOCIDO' then 4 when 'INCOHERENTE_LOCAL_SUPRIMIDO' then 5 else 9 end, channels desc, at_ms, file, event_id) as k, count(*) over (partition by event_file) as n from cand) where k = 1)
"""
_RECL = "case when f is null or s is null or semblance is null or v is null then null when f >= 0.3 and s >= 0.3 and semblance >= {c} and abs(v) between 1500 and 8000 then 'SISMO_CONFIRMADO' when f >= 0.5 and s >= 0.5 then 'POSIBLE_REGIONAL_EMERGENTE' else 'COHERENTE_DESCONOCIDO' end"
_CANDS = "(values (0.05), (0.08), (0.12), (0.2), (0.35)) t(c)"
_STEPS = "steps as (select array_id, updated, (x->>'snr')::double as snr, (x->>'n')::bigint as n, (x->>'hits')::bigint as hits, (x->>'recall')::double as recall from (select distinct array_id, updated, recall_curve_json from array_profiles where recall_curve_json is not null and array_id is not null), lateral (select unnest(cast(recall_curve_json as json[])) as x) u)"
_MERGED = """last as (select *, row_number() over (partition by array_id order by updated desc, snapshot_at desc) as k from array_profiles where array_id is not null and updated is not null),
merged as (select array_id, max(updated) as updated, max(case when k = 1 then fs end) as fs, max(case when k = 1 then dx end) as dx, max(case when k = 1 then n_ch end) as n_ch, max(case when k = 1 then aperture_m end) as aperture_m,
  arg_max(thresholds_json, (updated, snapshot_at)) filter (thresholds_json is not null) as thresholds_json, arg_max(synth_recall, (updated, snapshot_at)) filter (synth_recall is not null) as synth_recall, arg_max(snr50, (updated, snapshot_at)) filter (snr50 is not null) as snr50 from last group by array_id)"""
_CLUSTERS = "c as (select id, max(n_events) as n_events, min(array_id) as array_id from unknown_clusters where id is not null group by id), named as (select array_id as label, id, n_events from (select *, row_number() over (partition by array_id order by n_events desc, id) as k from c where n_events >= 5 and array_id is not null) where k = 1)"

_ANSWER = "case {k} when 'SISMO_CONFIRMADO' then 'HIT' when 'POSIBLE_REGIONAL_EMERGENTE' then 'HONEST_REGIONAL' when 'COHERENTE_DESCONOCIDO' then 'HONEST_UNKNOWN' else 'MISS_SUPPRESSED' end"
_OUTCOME = f""", loud as (select file, classification from (select file, classification, row_number() over (partition by file order by coalesce(coherent_channels, 0) desc, case when not isnan(time_offset_s) then time_offset_s else cast('inf' as double) end nulls last, event_id, classification) as k from resultados where file is not null and event_id is not null) where k = 1)
select d.event_file, case when magnitude is null and d.origin_ms is null then case when verdict = 'SISMO_CONFIRMADO' then 'FALSE_ALARM' else 'CORRECT_REJECTION' end when d.origin_ms is not null and b.classification is null then 'MISS_BELOW_FLOOR'
  when d.origin_ms is not null then {_ANSWER.format(k="b.classification")} else {_ANSWER.format(k="l.classification")} end as outcome from dec d left join best b using (event_file) left join loud l on l.file = d.event_file"""
_SCORES = f"""sim as (select arr, event_file, c::double as candidate, outcome as was, {_RECL.format(c='c')} as k, magnitude is not null or origin_ms is not null as known from dec cross join {_CANDS}),
swept as (select *, case when known then {_ANSWER.format(k='k')} when k = 'SISMO_CONFIRMADO' then 'FALSE_ALARM' else 'CORRECT_REJECTION' end as outcome from sim where k is not null),
counted as (select arr as array, candidate, count_if(was <> outcome) as changes, count_if(was = 'MISS_BELOW_FLOOR' and outcome in ('HIT', 'HONEST_REGIONAL', 'HONEST_UNKNOWN')) as improves, count_if(outcome in ('FALSE_ALARM', 'MISS_SUPPRESSED') and was not in ('FALSE_ALARM', 'MISS_SUPPRESSED')) as worsens, count_if(was in ('HIT', 'HONEST_REGIONAL', 'HONEST_UNKNOWN') and outcome = 'MISS_BELOW_FLOOR') as downgrades from swept group by all),
scored as (select *, cast(improves - 2 * worsens - 0.5 * downgrades as double) as net, worsens = 0 and improves - 2 * worsens - 0.5 * downgrades > 0 as eligible from counted)"""
_PROPOSED = f"""{_SCORES}, {_MERGED},
config as (select a.array_id as array, coalesce((thresholds_json->>'seismic_min_semblance')::double, 0.12) as old_value from arrays a left join merged using (array_id)),
chosen as (select s.array, arg_max(candidate, (net, -candidate)) as best from scored s where eligible group by s.array),
proposed as (select c.array, 'seismic_min_semblance' as param, old_value, coalesce(best, old_value) as new_value, best is null as retained from config c left join chosen h on h.array = c.array)"""
SQL = {
    "calibration_score": f"with {DECODED}, {_SCORES} select * from scored",
    "calibration_proposals": f"with {DECODED}, {_PROPOSED} select * from proposed",
    "calibration_applied": f"with {DECODED}, {_PROPOSED} select m.array_id, case when not retained and new_value <> old_value then new_value else try_cast(thresholds_json->>'seismic_min_semblance' as double) end as min_semblance from merged m left join proposed p on p.array = m.array_id",
    "pipeline_margin": "select array_id, round(aperture_m / 1500.0 + 1, 6) as margin_s from arrays",
    "scoped_match": """with ok as (select id, n_events, array_id, vec::double[] as v, row_number() over (partition by id order by n_events desc nulls last, last_seen desc nulls last) as k from unknown_clusters where id is not null and len(vec) = 64 and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0),
one as (select id, n_events, array_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as u from ok where k = 1),
proto as (select array_id as label, id, n_events, u from (select *, row_number() over (partition by array_id order by n_events desc, id) as k from one where n_events >= 5 and array_id is not null) where k = 1),
seen as (select p.label, count(*) as more from one o join proto p on p.label = o.array_id where round(list_dot_product(o.u, p.u), 9) >= 0.85 group by all)
select label, id, n_events + coalesce(more, 0) as n_events from proto left join seen using (label)""",
    "ledger_latest": f"with {NOW} select event_file, verdict, outcome, ts from now",
    "ledger_decoded": f"with {DECODED} select event_file, magnitude, distance_km, semblance, n_candidates, origin_ms from dec",
    "ledger_invalidated": f"with {NOW} select array_id, 'geometry revised' as reason, count(*) as n from now where array_id in (select array_id from arrays where n_ch >= 2000) group by all",
    "profile_merge": f"with {_MERGED} select array_id, updated, fs, dx, n_ch, aperture_m, synth_recall, snr50 from merged",
    "profile_config": f"with {_MERGED} select a.array_id, coalesce((thresholds_json->>'threshold')::double, 4.0) as threshold, coalesce((thresholds_json->>'seismic_min_semblance')::double, 0.12) as min_semblance from arrays a left join merged using (array_id)",
    "profile_archive": "select distinct array_id, fs, dx, n_ch, aperture_m, snr50, updated, 'before a new write' as note from array_profiles where recall_curve_json is not null and array_id is not null",
    "resolvable_speed": "select distinct array_id, aperture_m, fs, round(aperture_m * fs / 3, 4) as v_max from array_profiles where aperture_m is not null and fs is not null",
    "nearest_prototype": "with p as (select label, list(m order by i) as proto from (select label, i, avg(embedding[i]::double) as m from embeddings, range(1, 65) r(i) group by all) group by label), s as (select vec_id as id, label, round(list_dot_product(embedding::double[], proto) / ((sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-12) * (sqrt(list_dot_product(proto, proto)) + 1e-12)), 9) as c from (select vec_id, embedding from embeddings) cross join p) select id, label, round(c, 6) as similarity, c >= 0.3 as recognised from (select *, row_number() over (partition by id order by c desc, label) as k from s) where k = 1",
    "promote": f"with {_CLUSTERS} select * from named",
    "unpromoted": f"with {_CLUSTERS} select * from c where id not in (select id from named)",
    "causal_match": f"with {CAUSAL} select event_file, file, event_id, classification, channels, at_ms from cand",
    "best_candidate": f"with {CAUSAL} select event_file, file, event_id, classification, n, round((at_ms - origin_ms) / 1000.0, 6) as delay_s from best",
    "outcome_per_file": f"with {CAUSAL} {_OUTCOME}",
    "outcome_per_file_whole": f"with {CAUSAL} {_OUTCOME}",
    "outcome_matrix": f"with {DECODED}, t as (select magnitude is not null as real, count(*) as total from dec group by all), o as (select unnest(['CORRECT_REJECTION', 'FALSE_ALARM', 'HIT', 'HONEST_REGIONAL', 'HONEST_UNKNOWN', 'MISS_BELOW_FLOOR', 'MISS_SUPPRESSED']) as outcome), c as (select magnitude is not null as real, outcome, count(*) as n from dec group by all), x as (select t.real, o.outcome, coalesce(c.n, 0) as n, total from t cross join o left join c on c.real = t.real and c.outcome = o.outcome) select real, outcome, n, total, round(n / total, 6) as rate, round({WILSON_LOW.format(k='n', n='total')}, 6) as low, round({WILSON_HIGH.format(k='n', n='total')}, 6) as high from x",
    "array_outcomes": f"with {NOW} select arr as array, outcome, count(*) as n from timed group by rollup (arr, outcome)",
    "stale_hits": f"with {DECODED} select event_file from dec where outcome = 'HIT' and pinned is null",
    "detectability": f"with {DECODED}, {_MERGED} select event_file, magnitude, distance_km, coalesce(m.aperture_m, a.aperture_m) as aperture_m, outcome from dec d left join merged m on m.array_id = d.arr left join arrays a on a.array_id = d.arr where magnitude is not null",
    "delay_anomalies": "with recursive " + NOW + """,
val as (select arr, dt_detect_s as v, count(*) as c from timed where dt_detect_s is not null and not isnan(dt_detect_s) and not isinf(dt_detect_s) group by all),
step as (select a.arr, a.v, min(b.v) as nxt from val a left join val b on a.arr = b.arr and b.v > a.v and b.v - a.v > 0.1 group by all),
anchor as (select arr, min(v) as v from val group by arr union all select s.arr, s.nxt from anchor a join step s on a.arr = s.arr and a.v = s.v where s.nxt is not null)
select a.arr as array, a.v as anchor_s, cast(sum(m.c) as bigint) as n from anchor a join val m on a.arr = m.arr and m.v >= a.v and m.v - a.v <= 0.1 group by all having sum(m.c) >= 3""",
    "calibration_flips": f"with {DECODED} select c::double as candidate, verdict as from_verdict, now as to_verdict, count(*) as n from (select c, verdict, {_RECL.format(c='c')} as now from dec cross join {_CANDS}) where now is not null and verdict is not null and now <> verdict group by all",
    "calibration_choice": f"with {DECODED}, f as (select arr, c::double as candidate, verdict, {_RECL.format(c='c')} as now from dec cross join {_CANDS}), g as (select arr, candidate, count(*) as flips, count_if(verdict = 'SISMO_CONFIRMADO') as lost from f where now is not null and verdict is not null and now <> verdict group by all) select arr as array, candidate, flips from (select *, row_number() over (partition by arr order by candidate) as k from g where lost = 0) where k = 1",
    "recall_overlay": f"with {DECODED} select d.event_file, d.arr as array, n.snr_observed as snr, case when coalesce(d.n_candidates, 0) > 0 then 100 else 0 end as recall from dec d join now n using (event_file) where n.snr_observed is not null",
    "quiet_stretches": f"with {DECODED}, len as (select file, max(time_offset_s) as l from resultados where file is not null and not isnan(time_offset_s) group by file), s as (select len.file, l, d.origin_ms / 1000.0 - t.t as o from len left join dec d on d.event_file = len.file left join timed t on t.event_file = len.file), p as (select file, 0.0 as a, case when o is null then l else least(o - 5, l) end as b from s union all select file, greatest(o + 5, 0.0), l from s where o is not null) select file, round(a, 3) as from_s, round(b, 3) as to_s from p where b - a >= 10",
    "recall_gauge": f"with {NOW} select arr as array, round(avg(case when outcome = 'HIT' then 1 else 0 end), 6) as recall, count(*) as n from timed where outcome in ('HIT', 'HONEST_UNKNOWN', 'HONEST_REGIONAL', 'MISS_SUPPRESSED', 'MISS_BELOW_FLOOR') group by arr",
    "recall_curves": f"with {_STEPS} select *, round({WILSON_LOW.format(k='hits', n='n')}, 6) as low, round({WILSON_HIGH.format(k='hits', n='n')}, 6) as high from steps",
    "snr50": f"with {_STEPS}, l as (select *, lead(snr) over w as s2, lead(recall) over w as r2 from steps window w as (partition by array_id, updated order by snr)), x as (select *, row_number() over (partition by array_id, updated order by snr) as k from l where (recall - 0.5) * (r2 - 0.5) <= 0 and recall <> r2) select array_id, updated, round(snr + (0.5 - recall) / (r2 - recall) * (s2 - snr), 6) as snr50 from x where k = 1",
    "recall_falls": f"with {_STEPS}, b as (select *, {WILSON_LOW.format(k='hits', n='n')} as low, {WILSON_HIGH.format(k='hits', n='n')} as high from steps), l as (select *, lead(high) over (partition by array_id, updated order by snr) as nh from b) select array_id, updated, snr from l where nh < low",
}
