"""Queries of the Fourier kernels, micro-batched inference and the live path,
all over the grid signal of all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenarray.functions import signal
from lumenarray.plans.inference import micro_batched
from lumenarray.queries import arrays
from lumenarray.session import scratch
from lumenarray.sources.waveforms import traces
from lumenarray.streaming import triage as live


def filtered_envelope(spark, d):
    """Band-passed traces' envelopes (a sampling rate of 50 stands for the bins)."""
    t = signal.over_traces(traces(arrays.cells(spark, d)), lambda x: signal.envelope(signal.bandpass(x, 50.0, 1.0, 20.0)))
    return t.select("arr", "ch", F.posexplode("samples").alias("i", "envelope"))


def microbatch(spark, d):
    return micro_batched(traces(arrays.cells(spark, d)), lambda x: x.argmax(axis=1).tolist())


def stream_sta_lta(spark, d):
    """The grid fed to the live operator in chunks of 20 samples, the early and
    the late half of each channel as one micro-batch each."""
    home = scratch(spark, "live")
    t = traces(arrays.cells(spark, d)).withColumn("half", F.floor(F.size("samples") / 40) * 20)
    for late in (False, True):
        first, last = (F.col("half"), F.size("samples")) if late else (F.lit(0), F.col("half"))
        starts = F.when(last > first, F.sequence(first, last - 1, F.lit(20)))
        chunks = t.select("arr", "ch", "samples", last.alias("last"), F.explode(starts).alias("i0"))
        chunks = chunks.select("arr", "ch", F.col("i0").cast("int").alias("i0"), F.slice("samples", F.col("i0") + 1, F.least(F.lit(20), F.col("last") - F.col("i0")).cast("int")).alias("samples"))
        chunks.write.mode("append").parquet(f"{home}/chunks")
        q = live.sta_lta(spark.readStream.schema(live.CHUNK).parquet(f"{home}/chunks")).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        q.option("path", f"{home}/ratio").option("checkpointLocation", f"{home}/progress").start().awaitTermination()
    return spark.read.schema(live.RATIO).parquet(f"{home}/ratio").withColumn("ratio", F.round("ratio", 6))


QUERIES = {f.__name__: f for f in (filtered_envelope, microbatch, stream_sta_lta)}

SQL = {
    "microbatch": f"with {arrays.GRID} select arr, ch, cast(i as varchar) as result, cast(null as varchar) as error from (select *, row_number() over (partition by arr, ch order by a desc, i) as k from cells) where k = 1",
    "stream_sta_lta": arrays.SQL["sta_lta"].replace("1e-12 * m * m", "1e-12").replace("i < 29 or m = 0", "i < 29"),
}
