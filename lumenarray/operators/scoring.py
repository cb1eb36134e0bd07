"""Ground-truth matching, scoreboards, calibration and recall curves (R, B, V)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenarray.functions.files import file_start_s, with_array
from lumenarray.operators.ordered import previous_in_order
from lumenarray.session import cut
from lumenarray.sources.waveforms import finite

# Outcome labels, and the order in which verdicts answer an origin.
OUTCOMES = ["CORRECT_REJECTION", "FALSE_ALARM", "HIT", "HONEST_REGIONAL", "HONEST_UNKNOWN", "MISS_BELOW_FLOOR", "MISS_SUPPRESSED"]
PRIORITY = ["SISMO_CONFIRMADO", "POSIBLE_REGIONAL_EMERGENTE", "FUENTE_MOVIL_TRAFICO", "COHERENTE_DESCONOCIDO", "INCOHERENTE_LOCAL_SUPRIMIDO"]
ANSWER = {"SISMO_CONFIRMADO": "HIT", "POSIBLE_REGIONAL_EMERGENTE": "HONEST_REGIONAL", "COHERENTE_DESCONOCIDO": "HONEST_UNKNOWN", "FUENTE_MOVIL_TRAFICO": "MISS_SUPPRESSED", "INCOHERENTE_LOCAL_SUPRIMIDO": "MISS_SUPPRESSED"}
HONEST = ["HIT", "HONEST_REGIONAL", "HONEST_UNKNOWN"]
BAD = ["FALSE_ALARM", "MISS_SUPPRESSED"]
Z95 = 1.959963984540054


def causal_margin(distance_km: Column) -> Column:
    """Seconds after an origin in which its waves may arrive; 60 where unknown."""
    return F.coalesce(distance_km * 1000 / 2000 + 5, F.lit(60.0))


def candidates(truth: DataFrame, resultados: DataFrame, arrays: DataFrame, bucket_s: int = 60) -> DataFrame:
    """Verdicts within the causal margin of each origin (both ends inclusive).

    A range join on (array, time bucket): an origin goes to each bucket that
    its margin touches, a verdict to one, so a hot array is spread over time.
    """
    t = with_array(truth.filter("origin_ms is not null"), arrays).withColumn("to_ms", F.col("origin_ms") + F.round(causal_margin(F.col("distance_km")) * 1000).cast("bigint"))
    t = cut(t.select("event_file", "array", "origin_ms", "to_ms"))  # parsed once: the parsing alone fills a stage
    t = t.select("event_file", "array", "origin_ms", "to_ms", F.explode(F.sequence(F.floor(F.col("origin_ms") / (1000 * bucket_s)), F.floor(F.col("to_ms") / (1000 * bucket_s)))).alias("b"))
    v = with_array(resultados.filter("time_offset_s is not null and not isnan(time_offset_s)").select("file", "event_id", "classification", "coherent_channels", "time_offset_s"), arrays, "file")
    v = v.withColumn("at_ms", F.round((file_start_s(F.col("file")) + F.col("time_offset_s")) * 1000).cast("bigint")).withColumn("b", F.floor(F.col("at_ms") / (1000 * bucket_s)))
    near = t.join(v, ["array", "b"]).filter("at_ms between origin_ms and to_ms")
    return near.select("event_file", "origin_ms", "file", "event_id", "classification", F.coalesce("coherent_channels", F.lit(0)).alias("channels"), "at_ms").distinct()


def best_candidates(c: DataFrame) -> DataFrame:
    """The candidate of best verdict, then most channels, then first in time."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("classification")), F.lit(9))
    row = F.struct(F.when(rank == 0, 9).otherwise(rank).alias("rank"), (-F.col("channels")).alias("_c"), "at_ms", "file", "event_id", "classification")
    return c.groupBy("event_file", "origin_ms").agg(F.min(row).alias("b"), F.count("*").alias("n")).select("event_file", "b.file", "b.event_id", "b.classification", "n", ((F.col("b.at_ms") - F.col("origin_ms")) / 1000).alias("delay_s"))


def loudest(truth: DataFrame, resultados: DataFrame) -> DataFrame:
    """For truth without an origin, the verdict with most channels of the whole
    file; ties take the first in time (unknown times last), then the least
    event_id, then the least classification."""
    v = resultados.filter("file is not null and event_id is not null")
    time = F.when(~F.isnan("time_offset_s"), F.col("time_offset_s"))
    row = F.struct((-F.coalesce("coherent_channels", F.lit(0))).alias("_c"), F.coalesce(time, F.lit(float("inf"))).alias("_t"), "event_id", "classification")
    most = v.groupBy(F.col("file").alias("event_file")).agg(F.min(row).alias("b"))
    return truth.filter("magnitude is not null and origin_ms is null").select("event_file").join(most, "event_file").select("event_file", "b.event_id", "b.classification")


def outcomes(truth: DataFrame, best: DataFrame) -> DataFrame:
    """Outcome of each event file: no truth, no candidate, or what answered."""
    known = F.col("magnitude").isNotNull() | F.col("origin_ms").isNotNull()
    answered = F.coalesce(*(F.when(F.col("classification") == k, v) for k, v in ANSWER.items()))
    kind = F.when(~known, F.when(F.col("verdict") == PRIORITY[0], "FALSE_ALARM").otherwise("CORRECT_REJECTION")).when(F.col("origin_ms").isNotNull() & F.col("classification").isNull(), "MISS_BELOW_FLOOR").otherwise(F.coalesce(answered, F.lit("MISS_SUPPRESSED")))
    return truth.select("event_file", "verdict", "magnitude", "origin_ms").join(best.select("event_file", "classification"), "event_file", "left").select("event_file", kind.alias("outcome"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 1) for n = 0."""
    p, zz = k / n, z * z
    centre, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))


def outcome_matrix(rows: DataFrame) -> DataFrame:
    """Counts, rates and intervals of each outcome, for rows with and without
    truth; outcomes that don't occur are kept with 0."""
    counts = rows.groupBy(F.col("magnitude").isNotNull().alias("real"), "outcome").count()
    total = Window.partitionBy("real")
    cells = counts.groupBy("real").agg(F.sum("count").cast("bigint").alias("total"), F.map_from_entries(F.collect_list(F.struct("outcome", "count"))).alias("m"))
    d = cells.select("real", "total", "m", F.explode(F.array(*map(F.lit, OUTCOMES))).alias("outcome")).withColumn("n", F.coalesce(F.try_element_at("m", F.col("outcome")), F.lit(0)))
    low, high = wilson(F.col("n"), F.col("total"))
    return d.select("real", "outcome", "n", "total", (F.col("n") / F.col("total")).alias("rate"), low.alias("low"), high.alias("high"))


def repeated_delays(readings: DataFrame, tolerance: float = 0.1, least: int = 3) -> DataFrame:
    """array, anchor_s, n: clusters of detection delays, each anchored at its
    first value and holding those at most `tolerance` above it. Null and
    non-finite delays are left out.

    Delays are counted by value first. A gap wider than the tolerance always
    parts clusters, so each island of values between such gaps is gone through
    by itself; a step leaps to the first value beyond the anchor's reach.
    """
    d = readings.filter("array is not null").select("array", finite(F.col("delay")).alias("v")).filter("v is not null")
    counts = d.groupBy("array", "v").count()
    p = previous_in_order(counts, ["array"], ["v"], F.floor("v"), ["v"])
    starts = F.when(F.col("prev").isNull() | (F.col("v") - F.col("prev.v") > tolerance), F.col("v"))
    p = p.withColumn("_from", starts).withColumn("_k", F.floor("v")).drop("prev")
    last = p.groupBy("array", "_k").agg(F.max("_from").alias("_last"))
    carried = last.select("array", "_k", F.last("_last", ignorenulls=True).over(Window.partitionBy("array").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    here = F.last("_from", ignorenulls=True).over(Window.partitionBy("array", "_k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    islands = p.withColumn("_here", here).join(carried, ["array", "_k"]).select("array", "v", "count", F.coalesce("_here", "_carried").alias("island"))

    def clusters(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("v")
        v, total = g["v"].to_numpy(), np.append(0, np.cumsum(g["count"].to_numpy()))
        out, i = [], 0
        while i < len(v):
            j = int(np.searchsorted(v, v[i] + tolerance, side="right"))
            while j < len(v) and v[j] - v[i] <= tolerance:
                j += 1
            while v[j - 1] - v[i] > tolerance:
                j -= 1
            out.append((g["array"].iloc[0], v[i], int(total[j] - total[i])))
            i = j
        return pd.DataFrame(out, columns=["array", "anchor_s", "n"])

    return islands.groupBy("array", "island").applyInPandas(clusters, "array string, anchor_s double, n bigint").filter(F.col("n") >= least)


def reclassified(rows: DataFrame, least_semblance: Column) -> Column:
    """Verdict from the four cached metrics; null if any is missing."""
    f, s, sem, v = (F.col(c) for c in ("coincidence_fraction", "span_fraction", "semblance", "apparent_velocity_mps"))
    seismic = (f >= 0.30) & (s >= 0.30) & (sem >= least_semblance) & F.abs(v).between(1500, 8000)
    return F.when(f.isNull() | s.isNull() | sem.isNull() | v.isNull(), None).when(seismic, PRIORITY[0]).when((f >= 0.5) & (s >= 0.5), PRIORITY[1]).otherwise(PRIORITY[3])


def calibration_flips(rows: DataFrame, candidates: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Per candidate bound and change of verdict (and `keys`): how many rows would flip."""
    d = rows.withColumn("candidate", F.explode(F.array(*map(F.lit, candidates))))
    d = d.withColumn("to_verdict", reclassified(d, F.col("candidate"))).filter("to_verdict is not null and verdict is not null and to_verdict <> verdict")
    return d.groupBy(*keys, "candidate", F.col("verdict").alias("from_verdict"), "to_verdict").count().withColumnRenamed("count", "n")


def calibration_outcomes(rows: DataFrame, candidates: tuple[float, ...]) -> DataFrame:
    """array, event_file, candidate, outcome: what each ledger row with the four
    metrics would have come to under each candidate bound."""
    d = rows.withColumn("candidate", F.explode(F.array(*map(F.lit, candidates))))
    d = d.withColumn("classification", reclassified(d, F.col("candidate"))).filter("classification is not null")
    answered = F.coalesce(*(F.when(F.col("classification") == k, v) for k, v in ANSWER.items()))
    known = F.col("magnitude").isNotNull() | F.col("origin_ms").isNotNull()
    outcome = F.when(known, answered).when(F.col("classification") == PRIORITY[0], "FALSE_ALARM").otherwise("CORRECT_REJECTION")
    return d.select("array", "event_file", "candidate", outcome.alias("outcome"))


def sweep_scores(outcomes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Of each candidate but the baseline's own: how many outcomes improve (from
    below the floor to an honest one), worsen (into a bad one) or are
    downgraded (from an honest one to below the floor), and the net score.

    outcomes: array, event_file, candidate, outcome; baseline: array,
    event_file, outcome. eligible: nothing worsens and the net is above 0.
    """
    d = outcomes.join(baseline.withColumnRenamed("outcome", "was"), ["array", "event_file"])
    c = lambda cond: F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("int")), F.lit(0))
    was, now = F.col("was"), F.col("outcome")
    out = d.groupBy("array", "candidate").agg(
        c(was != now).alias("changes"), c((was == "MISS_BELOW_FLOOR") & now.isin(HONEST)).alias("improves"), c(now.isin(BAD) & ~was.isin(BAD)).alias("worsens"), c(was.isin(HONEST) & (now == "MISS_BELOW_FLOOR")).alias("downgrades")
    )
    net = F.col("improves") - 2 * F.col("worsens") - 0.5 * F.col("downgrades")
    return out.withColumn("net", net.cast("double")).withColumn("eligible", (F.col("worsens") == 0) & (F.col("net") > 0))


def proposals(scores: DataFrame, arrays: DataFrame, param: str, current: Column) -> DataFrame:
    """array, param, old_value, new_value, retained: the eligible candidate of
    the greatest net score (ties: the lower) of each array; where there is
    none, the value in force is proposed again, so that the sweep is on record.
    arrays: array and what `current` needs."""
    best = scores.filter("eligible").groupBy("array").agg(F.max_by("candidate", F.struct("net", -F.col("candidate"))).alias("best"))
    d = arrays.select("array", current.cast("double").alias("old_value")).join(best, "array", "left")
    return d.select("array", F.lit(param).alias("param"), "old_value", F.coalesce("best", "old_value").alias("new_value"), F.col("best").isNull().alias("retained"))


def applied(profiles: DataFrame, proposed: DataFrame, field: str) -> DataFrame:
    """Profiles (array_id, thresholds_json, ...) with the proposals that change
    something written into thresholds_json; other keys stay."""
    p = proposed.filter("not retained and new_value <> old_value").select(F.col("array").alias("array_id"), "new_value")
    kept = F.from_json("thresholds_json", "map<string,string>")
    merged = F.map_concat(F.map_filter(F.coalesce(kept, F.create_map().cast("map<string,string>")), lambda k, _: k != field), F.create_map(F.lit(field), F.col("new_value").cast("string")))
    return profiles.join(p, "array_id", "left").withColumn("thresholds_json", F.when(F.col("new_value").isNotNull(), F.to_json(merged)).otherwise(F.col("thresholds_json"))).drop("new_value")


def curves(profiles: DataFrame) -> DataFrame:
    """Steps of every distinct recall curve: array_id, updated, snr, n, hits, recall."""
    steps = F.from_json("recall_curve_json", "array<struct<snr: double, n: bigint, hits: bigint, recall: double>>")
    d = profiles.filter("recall_curve_json is not null and array_id is not null").select("array_id", "updated", "recall_curve_json").distinct()
    return d.select("array_id", "updated", F.explode(steps).alias("s")).select("array_id", "updated", "s.*")


def snr50(steps: DataFrame) -> DataFrame:
    """array_id, updated, snr50: where the recall first crosses one half, up or
    down (a step at one half counts), by linear interpolation between steps
    that differ; no row for curves that never do."""
    order = Window.partitionBy("array_id", "updated").orderBy("snr")
    d = steps.withColumn("s2", F.lead("snr").over(order)).withColumn("r2", F.lead("recall").over(order)).filter("(recall - 0.5) * (r2 - 0.5) <= 0 and recall <> r2")
    at = F.col("snr") + (0.5 - F.col("recall")) / (F.col("r2") - F.col("recall")) * (F.col("s2") - F.col("snr"))
    return d.groupBy("array_id", "updated").agg(F.min_by(at, "snr").alias("snr50"))


def falling(steps: DataFrame) -> DataFrame:
    """Steps after which the recall falls beyond both intervals."""
    low, high = wilson(F.col("hits"), F.col("n"))
    order = Window.partitionBy("array_id", "updated").orderBy("snr")
    d = steps.withColumn("low", low).withColumn("high", high)
    return d.withColumn("next_high", F.lead("high").over(order)).filter("next_high < low").select("array_id", "updated", "snr")


def calibration_choice(flips: DataFrame, candidates: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """The first candidate, in the given order, that flips rows but none from
    confirmed (of each of `keys`); no row if there is none."""
    place = F.array_position(F.array(*map(F.lit, candidates)), F.col("candidate"))
    per = flips.groupBy(*keys, "candidate").agg(F.sum("n").alias("flips"), F.sum(F.when(F.col("from_verdict") == PRIORITY[0], F.col("n")).otherwise(0)).alias("lost")).filter("lost = 0").withColumn("_p", place)
    return per.groupBy(*keys).agg(F.min(F.struct("_p", "candidate", "flips")).alias("b")).filter("b is not null").select(*keys, "b.candidate", "b.flips")


def pipeline_margin(aperture_m: Column, v_min: float = 1500.0) -> Column:
    """Seconds that a window needs on each side of an event, so that no shift of
    the slant stack leaves it."""
    return aperture_m / v_min + 1


def overlay(ledger: DataFrame, arrays: DataFrame) -> DataFrame:
    """array, snr, recall: each observed ratio, 100 where a causal candidate was
    seen and 0 where not, to lay over a recall curve."""
    from lumenarray.functions.files import current
    from lumenarray.operators.nested import whole_json

    now = with_array(current(ledger, "snr_observed", "metrics_json").filter("snr_observed is not null"), arrays)
    n = F.get_json_object(whole_json(F.col("metrics_json")), "$.n_candidates_causal_window").try_cast("bigint")
    return now.select("event_file", "array", F.col("snr_observed").alias("snr"), F.when(F.coalesce(n, F.lit(0)) > 0, 100).otherwise(0).alias("recall"))
