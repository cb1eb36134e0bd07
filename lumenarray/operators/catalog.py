"""Signature prototypes, ledger and profiles as tables.

Upserts are an append log read through a latest-wins view; nothing is changed
in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenarray.functions.files import absolute_ms, current
from lumenarray.operators.nested import whole_json


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def prototypes(signatures: DataFrame, label: str, vec: str, dim: int) -> DataFrame:
    """label, proto: the mean signature of each label."""
    return signatures.groupBy(F.col(label).alias("label")).agg(F.array(*(F.avg(F.col(vec)[i]) for i in range(dim))).alias("proto"))


def nearest_prototype(signatures: DataFrame, protos: DataFrame, tau: float = 0.85, scope: str | None = None, block_rows: int = 50_000) -> DataFrame:
    """signatures (id, vec) with the most similar prototype (ties: least label)
    and whether it is recognised. scope: a column of both sides; a signature
    meets the prototypes of its own scope only (none, if that is null), and
    gives no row where there are none.

    Prototypes travel with the tasks in blocks of at most block_rows, each a
    matrix of unit rows; a batch of signatures meets a block in one product.
    """
    cols = ["label", "proto"] + ([scope] if scope else [])
    n = protos.count()
    blocks = max(1, -(-n // block_rows))
    out = None
    for k in range(blocks):
        mine = protos.filter(F.pmod(F.xxhash64("label"), F.lit(blocks)) == k) if blocks > 1 else protos
        rows = mine.select(*cols).filter("label is not null and proto is not null").orderBy("label").collect()
        matrix = np.array([r.proto for r in rows], float) if rows else np.zeros((0, 1))
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-12
        held = signatures.sparkSession.sparkContext.broadcast((matrix, [r.label for r in rows], np.array([r[scope] for r in rows], object) if scope else None))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            matrix, labels, scopes = held.value
            for b in batches:
                for a in range(0, len(b) if len(labels) else 0, 2_000):
                    part = b.iloc[a : a + 2_000]
                    x = np.stack(part["vec"].to_numpy()).astype(float)
                    c = np.round((x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)) @ matrix.T, 9)
                    if scopes is not None:
                        c[part["scope"].to_numpy(object)[:, None] != scopes] = -2
                    best = c.argmax(axis=1)
                    near = c[np.arange(len(c)), best]
                    keep = near > -2
                    yield pd.DataFrame({"id": part["id"].to_numpy()[keep], "label": np.array(labels, object)[best[keep]], "similarity": near[keep]})

        s = signatures.filter("vec is not null").select("id", "vec", *([F.col(scope).alias("scope")] if scope else []))
        s = s.filter("scope is not null") if scope else s
        got = s.mapInPandas(run, f"id {dict(signatures.dtypes)['id']}, label {dict(protos.dtypes)['label']}, similarity double")
        out = got if out is None else out.unionByName(got)
    if blocks > 1:
        least = F.struct((-F.col("similarity")).alias("far"), "label", "similarity")
        out = out.groupBy("id").agg(F.min(least).alias("b")).select("id", "b.label", "b.similarity")
    return out.withColumn("recognised", F.col("similarity") >= tau)


def recounted(protos: DataFrame, matches: DataFrame) -> DataFrame:
    """Prototypes (label, n_events) with one event more for each signature that
    was recognised as theirs."""
    more = matches.filter("recognised").groupBy("label").agg(F.count("*").alias("_more"))
    return protos.join(more, "label", "left").withColumn("n_events", F.col("n_events") + F.coalesce("_more", F.lit(0))).drop("_more")


def promoted(clusters: DataFrame, naming: int, label: Column) -> DataFrame:
    """Prototypes from clusters with at least `naming` events: one per label, the
    cluster with most events (ties: the least id), with its vector, if it has one."""
    d = clusters.filter(F.col("n_events") >= naming).withColumn("label", label).filter("label is not null")
    moved = ["id", "n_events"] + (["vec"] if "vec" in clusters.columns else [])
    return d.groupBy("label").agg(F.max_by(F.struct(*moved), F.struct("n_events", -F.col("id"))).alias("c")).select("label", "c.*")


def named(clusters: DataFrame, names: DataFrame, protos: DataFrame) -> DataFrame:
    """Each wish to name a cluster (names: id, label) with what comes of it: ok,
    or why not - no such cluster, or a label that is taken by a prototype or by
    a wish of a lesser id."""
    w = names.join(clusters.select("id", F.lit(True).alias("_there")).distinct(), "id", "left").join(protos.select("label", F.lit(True).alias("_taken")).distinct(), "label", "left")
    first = F.row_number().over(Window.partitionBy("label").orderBy(F.col("_there").isNull(), "id"))
    w = w.withColumn("_first", first)
    state = F.when(F.col("_there").isNull(), "no such cluster").when(F.col("_taken").isNotNull() | (F.col("_first") > 1), "label taken").otherwise("ok")
    return w.select("id", "label", state.alias("state"))


def remaining(clusters: DataFrame, promoted_ids: DataFrame) -> DataFrame:
    """The clusters that were not moved to the prototypes."""
    return clusters.join(promoted_ids.select("id"), "id", "left_anti")


def invalidated(ledger: DataFrame, array_of: DataFrame, reason: str) -> DataFrame:
    """Audit copies of the current rows of the given arrays (array_id)."""
    now = current(ledger, "array_id", "verdict", "outcome", "ts")
    return now.join(array_of.select("array_id").distinct(), "array_id", "left_semi").withColumn("reason", F.lit(reason))


def decoded(ledger: DataFrame) -> DataFrame:
    """Current rows with the main fields of their JSON, null where it is broken."""
    now = current(ledger, "gt_json", "metrics_json", "verdict", "outcome", "ts")
    gt, m = whole_json(F.col("gt_json")), whole_json(F.col("metrics_json"))
    field = lambda j, name, kind="double": F.get_json_object(j, f"$.{name}").try_cast(kind)
    return now.select(
        "event_file", "verdict", "outcome", "ts", field(gt, "magnitude").alias("magnitude"), field(gt, "distance_km").alias("distance_km"), F.get_json_object(gt, "$.origin_time").alias("origin_time"),
        *(field(m, c).alias(c) for c in ("semblance", "coincidence_fraction", "span_fraction", "apparent_velocity_mps")), field(m, "n_candidates_causal_window", "bigint").alias("n_candidates"), field(m, "boundary_pinned", "boolean").alias("boundary_pinned"),
    ).withColumn("origin_ms", absolute_ms(F.col("origin_time")))


def merged_profiles(profiles: DataFrame) -> DataFrame:
    """One profile per array: geometry and noise of the last write, calibration
    fields the last that are not null."""
    at = F.struct(F.col("updated"), F.col("snapshot_at"))
    last = [F.max_by(c, F.struct("updated", "snapshot_at", F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in ("fs", "dx", "n_ch", "aperture_m", "noise_stats_json")]
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(at, F.col(c).cast("string")))).alias(c) for c in ("thresholds_json", "synth_recall", "recall_curve_json", "snr50")]
    return profiles.filter("array_id is not null and updated is not null").groupBy("array_id").agg(F.max("updated").alias("updated"), *last, *kept)


def configured(merged: DataFrame, arrays: DataFrame, threshold: float = 4.0, semblance: float = 0.12) -> DataFrame:
    """Each array's thresholds, the default where its profile has none."""
    j = merged.select("array_id", F.get_json_object("thresholds_json", "$.threshold").try_cast("double").alias("t"), F.get_json_object("thresholds_json", "$.seismic_min_semblance").try_cast("double").alias("s"))
    return arrays.select("array_id").join(j, "array_id", "left").select("array_id", F.coalesce("t", F.lit(threshold)).alias("threshold"), F.coalesce("s", F.lit(semblance)).alias("min_semblance"))


def archived(profiles: DataFrame, note: str) -> DataFrame:
    """History rows of the profiles that have a recall curve."""
    return profiles.filter("recall_curve_json is not null and array_id is not null").select("array_id", "fs", "dx", "n_ch", "aperture_m", "snr50", "updated").distinct().withColumn("note", F.lit(note))
