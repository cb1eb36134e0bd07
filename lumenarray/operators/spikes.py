"""Problem 5: implausible readings of a source, by a Kalman filter.

Each source's readings (on a log scale) follow a local-level state-space model
whose drift and noise are estimated from that source. A reading is forecast
from the readings before it only; one whose standardised innovation is above
the threshold is flagged and withheld from the update. A run of readings whose
innovations, against the forecast made before the run, all but stop varying is
flagged as stuck; readings outside the physical range are flagged as
impossible and never reach the filter.

The filter's memory is the last MEMORY readings, so a source is cut into
segments that run side by side, and the flags don't depend on where.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenarray.operators.ordered import numbered
from lumenarray.session import cut

THRESHOLD = 6.0  # of the standardised innovation
MEMORY = 64  # readings a forecast looks back on
SHIFT = 6  # readings withheld in a row, on one side, are a new level
STUCK_RUN = 4
STILL = 0.02  # of the source's noise: the deviation of a stuck run
LEAST_NOISE = 1e-3
SEGMENT_ROWS = 20_000
FLAGS = "source string, field string, key string, reading double, kind string, innovation double, deviation double, run_range double"


def usual(rows: DataFrame) -> DataFrame:
    """Per source and field: middle and spread of the logarithms (y), and the
    model's noise, drift (variances) and first variance of the level.

    With d1 and d8 the typical size of a change over one and eight readings,
    d1^2 = 2 noise + drift and d8^2 = 2 noise + 8 drift. Medians are taken of
    values rounded to 1e-4, so that a source comes to few distinct ones.
    rows: a source's readings by segment, lead-in included (own is false).
    """
    by = ["source", "field"]
    order = Window.partitionBy(*by, "segment").orderBy("place")
    d = rows.withColumn("_1", F.col("y") - F.lag("y").over(order)).withColumn("_8", F.col("y") - F.lag("y", 8).over(order)).filter("own")
    median = lambda c: F.percentile(F.round(c, 4), F.lit(0.5))
    first = d.groupBy(*by).agg(median(F.col("y")).alias("middle"), (1.4826 * median(F.abs("_1"))).alias("d1"), (1.4826 * median(F.abs("_8"))).alias("d8"))
    spread = rows.filter("own and y is not null").join(first.select(*by, "middle"), by).groupBy(*by).agg((1.4826 * median(F.abs(F.col("y") - F.col("middle")))).alias("spread"))
    least = F.lit(LEAST_NOISE)
    s = first.join(spread, by).withColumn("spread", F.greatest("spread", least)).withColumn("d1", F.greatest(F.coalesce("d1", F.col("spread") * 2**0.5), least))
    drift = F.least(F.greatest((F.coalesce(F.col("d8") * F.col("d8"), F.lit(0.0)) - F.col("d1") * F.col("d1")) / 7, 1e-4 * F.col("d1") * F.col("d1")), 0.9 * F.col("d1") * F.col("d1"))
    noise = F.greatest((F.col("d1") * F.col("d1") - F.col("drift")) / 2, least * least)
    s = s.withColumn("drift", drift).withColumn("noise", noise)
    return s.select(*by, "middle", "spread", "noise", "drift", F.greatest(F.col("spread") * F.col("spread") - F.col("noise"), 0.05 * F.col("noise")).alias("start"))


def innovations(y: np.ndarray, lead: int, middle: float, noise: float, drift: float, start: float, threshold: float) -> np.ndarray:
    """Standardised innovations of y[lead:], each forecast from the MEMORY
    values before it (nan: no reading), all at once, step by step of their
    look-back. Values above the threshold are withheld from the update, unless
    SHIFT of them in a row lie on one side: then the level has moved."""
    padded = np.concatenate([np.full(max(0, MEMORY - lead), np.nan), y[max(0, lead - MEMORY) :]])
    past = np.lib.stride_tricks.sliding_window_view(padded, MEMORY + 1)
    n = len(past)
    level, var, streak, side = np.full(n, middle), np.full(n, start), np.zeros(n, np.int8), np.zeros(n)
    with np.errstate(invalid="ignore"):
        for k in range(MEMORY):
            var = var + drift
            e = past[:, k] - level
            seen = ~np.isnan(e)
            far = seen & (np.abs(e) > threshold * np.sqrt(var + noise))
            streak = np.where(far, np.where(np.sign(e) == side, streak + 1, 1), np.where(seen, 0, streak)).astype(np.int8)
            side = np.where(far, np.sign(e), side)
            moved = streak >= SHIFT
            gain = np.where(moved, 1.0, var / (var + noise))
            use = seen & (moved | ~far)
            level = np.where(use, level + gain * e, level)
            var = np.where(moved, noise, np.where(use, var * (1 - gain), var))
            streak[moved] = 0
        return (past[:, MEMORY] - level) / np.sqrt(var + drift + noise)


def _filter(threshold: float, still: float):
    """Flags of one segment; lead-in rows before and the rows of a run after
    its own are only looked at."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("place", kind="stable")
        own = g["own"].to_numpy(bool)
        at = np.flatnonzero(own)
        if not len(at):
            return pd.DataFrame(columns=[c.split()[0] for c in FLAGS.split(", ")])
        p = {c: float(g[c].iloc[0]) for c in ("middle", "spread", "noise", "drift", "start")}
        y, x = g["y"].to_numpy(float), g["reading"].to_numpy(float)
        score = np.full(len(g), np.nan)
        score[at[0] : at[-1] + 1] = innovations(y[: at[-1] + 1], at[0], p["middle"], p["noise"], p["drift"], p["start"], threshold)
        reach = np.full(len(g), np.inf)
        if len(g) >= STUCK_RUN:
            runs = np.lib.stride_tricks.sliding_window_view(x, STUCK_RUN)
            with np.errstate(invalid="ignore", over="ignore"):
                size, dev, mean = runs.max(axis=1) - runs.min(axis=1), runs.std(axis=1), np.abs(runs.mean(axis=1))
                stuck = (dev <= still * np.sqrt(p["noise"]) * mean) | (size == 0)
            size = np.where(stuck, size, np.inf)
            for k in range(STUCK_RUN):
                reach[k : k + len(size)] = np.minimum(reach[k : k + len(size)], size)
        ok = g["ok"].to_numpy(bool)
        far = ok & (np.abs(np.nan_to_num(score)) > threshold)
        kind = np.where(~ok, "impossible", np.where(far, "spike", np.where(reach < np.inf, "stuck", None)))
        keep = own & (kind != None)  # noqa: E711
        out = g.loc[keep, ["source", "field", "key", "reading"]]
        return out.assign(kind=kind[keep], innovation=np.where(ok, score, np.nan)[keep], deviation=((y - p["middle"]) / p["spread"])[keep], run_range=np.where(reach < np.inf, reach, np.nan)[keep])

    return run


def implausible(readings: DataFrame, segment_rows: int = SEGMENT_ROWS, threshold: float = THRESHOLD, still: float = STILL) -> DataFrame:
    """Flagged readings of (source, field, key, at, reading, ok).

    `at` orders a source's readings (ties by key), `ok` says that the reading
    is physically possible (and positive; a reading of exactly zero has no
    logarithm and never reaches the filter). Null readings are left out and
    don't part successive ones; rows with a null source, field or time are
    dropped. A source with constant readings has a least deviation of 0.001;
    one that has no possible reading gives its impossible ones only. Output
    (FLAGS): kind is impossible, spike or stuck, the first that holds;
    innovation is standardised (null for impossible ones), deviation the
    distance from the source's middle in its spreads, run_range the range of
    the narrowest stuck run that holds the reading.
    """
    by = ["source", "field"]
    r = readings.select(*by, "key", "at", "reading", "ok").filter("reading is not null and source is not null and field is not null and at is not null")
    r = r.withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("y", F.when(F.col("ok") & (F.col("reading") > 0), F.ln("reading")))
    d = cut(numbered(cut(r), by, "at", ["at", "key", "reading"], into="place"))
    part = lambda c: F.floor(c / segment_rows)
    segments = F.sequence(F.greatest(part(F.col("place") - (STUCK_RUN - 1)), F.lit(0)), part(F.col("place") + MEMORY))
    spread = d.withColumn("segment", F.explode(segments)).withColumn("own", F.col("segment") == part(F.col("place")))
    blank = {"middle": 0.0, "spread": LEAST_NOISE, "noise": LEAST_NOISE**2, "drift": 1e-4 * LEAST_NOISE**2, "start": LEAST_NOISE**2}
    known = spread.join(usual(spread), by, "left").fillna(blank)
    return known.groupBy(*by, "segment").applyInPandas(_filter(threshold, still), FLAGS)


def possible(field: Column, reading: Column) -> Column:
    """The physical range of each reading of the ledger."""
    finite = ~F.isnan(reading) & (F.abs(reading) != float("inf"))
    return finite & F.when(field == "dt_detect_s", (reading > 0) & (reading <= 60)).otherwise(reading > 0)


def ledger_readings(ledger: DataFrame, arrays: DataFrame) -> DataFrame:
    """Readings of the current ledger rows, by the array of the file prefix."""
    from lumenarray.functions.files import current, file_start_s, with_array

    now = with_array(current(ledger, "dt_detect_s", "snr_observed"), arrays)
    long = now.selectExpr("array as source", "event_file as key", "dt_detect_s", "snr_observed").withColumn("at", file_start_s(F.col("key")))
    long = long.selectExpr("source", "key", "at", "stack(2, 'dt_detect_s', dt_detect_s, 'snr_observed', snr_observed) as (field, reading)")
    return long.filter("reading is not null").withColumn("ok", possible(F.col("field"), F.col("reading")))


# What counts as a case of the ledger.
CASE_DEVIATION, CASE_RANGE = 6.75, 0.004


def ledger_cases(ledger: DataFrame, arrays: DataFrame) -> DataFrame:
    """event_file, field of the ledger's cases: the filter finds candidates at a
    lower threshold and with a wider idea of stillness; of these the spikes
    must lie CASE_DEVIATION spreads from their array's middle, and the stuck
    ones in a run no wider than CASE_RANGE."""
    f = implausible(ledger_readings(ledger, arrays), threshold=4.5, still=0.25)
    case = (F.col("kind") == "impossible") | ((F.abs("innovation") > 4.5) & (F.abs("deviation") > CASE_DEVIATION)) | (F.col("run_range") <= CASE_RANGE)
    return f.filter(case).select(F.col("key").alias("event_file"), "field").distinct()
