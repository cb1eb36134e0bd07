"""Recall against signal-to-noise ratio by injection.

Known plane waves are added to recorded noise, one copy of each array for each
ratio, and the triage runs over all copies at once as over any other arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarray.operators.scoring import wilson
from lumenarray.operators.triage import Tier0, extract_events, raster, sta_lta

# The ratios of the recall curve; a short wavelet in whole numbers.
RATIOS = (1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0)
WAVELET = (1, 2, -3, 5, -3, 2, 1)


def noise_level(cells: DataFrame) -> DataFrame:
    """arr, noise: the median over channels of each channel's RMS."""
    per = cells.groupBy("arr", "ch").agg(F.sqrt(F.avg(F.col("a") * F.col("a"))).alias("rms"))
    return per.groupBy("arr").agg(F.median("rms").alias("noise"))


def injected(cells: DataFrame, ratios: tuple[float, ...] = RATIOS, wavelet: tuple[int, ...] = WAVELET, first: int = 40, span: int = 60) -> DataFrame:
    """Cells of a copy of each array for each ratio: arr (array * ratios + k),
    ch, i, a, t0, k. A wave crosses one channel a sample from t0 on, which
    differs between copies; its amplitude is the ratio times the array's noise
    over the wavelet's RMS."""
    power = math.sqrt(sum(x * x for x in wavelet) / len(wavelet))
    trials = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(r)).alias("snr")) for k, r in enumerate(ratios))))
    d = cells.join(noise_level(cells), "arr").withColumn("t", trials).select("arr", "ch", "i", "a", "noise", "t.k", "t.snr")
    d = d.withColumn("t0", first + (F.col("arr") * 13 + F.col("k") * 5) % span)
    j = (F.col("i") - F.col("t0") - F.col("ch")).cast("int")
    shape = F.when((j >= 0) & (j < len(wavelet)), F.element_at(F.array(*map(F.lit, wavelet)), F.when((j >= 0) & (j < len(wavelet)), j + 1).otherwise(1))).otherwise(0)
    wave = F.round(F.col("snr") * F.col("noise") / F.lit(power) * shape).cast("bigint")
    return d.select((F.col("arr") * len(ratios) + F.col("k")).alias("arr"), "ch", "i", (F.col("a") + wave).alias("a"), "t0", "k")


def recall_curve(cells: DataFrame, cfg: Tier0 = Tier0(), ratios: tuple[float, ...] = RATIOS, slack: int = 3) -> DataFrame:
    """snr, n, hits, recall, low, high: the share of copies in which an event
    holds the wave's start (within `slack` samples), with Wilson bounds."""
    copies = injected(cells, ratios)
    events = extract_events(raster(sta_lta(copies.select("arr", "ch", "i", "a"), cfg), cfg), cfg)
    trials = copies.select("arr", "t0", "k").distinct()
    seen = events.join(trials, "arr").filter(f"t0 between i_from - {slack} and i_to + {slack}").select("arr").distinct().withColumn("hit", F.lit(1))
    per = trials.join(seen, "arr", "left").groupBy("k").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    snr = F.element_at(F.array(*map(F.lit, ratios)), F.col("k") + 1)
    return per.select(snr.alias("snr"), "n", "hits", (F.col("hits") / F.col("n")).alias("recall"), low.alias("low"), high.alias("high"))
