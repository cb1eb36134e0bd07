"""Outcomes, calibration and curves on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from lumenarray.operators import catalog, scoring

RESULTADOS = "file string, event_id string, classification string, coherent_channels int, time_offset_s double"
REST = "SISMO_CONFIRMADO", "COHERENTE_DESCONOCIDO", "INCOHERENTE_LOCAL_SUPRIMIDO"


def verdicts(spark):
    yes, unknown, no = REST
    rows = [("a_0.h5", "e1", no, None, 1.0), ("a_0.h5", "e2", unknown, 900, 50.0), ("a_0.h5", "e3", yes, 30, 2.0), ("b_0.h5", "e2", no, 40, 9.0), ("b_0.h5", "e9", yes, 40, 3.0), ("b_0.h5", "e1", no, 40, None), ("c_0.h5", "e1", yes, 5, 1.0), ("d_0.h5", "e1", yes, 5, 1.0)]
    return spark.createDataFrame(rows, RESULTADOS)


def test_truth_without_origin_takes_the_verdict_with_most_channels(spark):
    rows = [("a_0.h5", None, 2.0, None), ("b_0.h5", None, 2.0, None), ("c_0.h5", None, None, None), ("d_0.h5", None, 2.0, 1000), ("e_0.h5", None, 2.0, None)]
    truth = spark.createDataFrame(rows, "event_file string, verdict string, magnitude double, origin_ms bigint")
    best = scoring.loudest(truth, verdicts(spark))
    got = {r.event_file: r.outcome for r in scoring.outcomes(truth, best).collect()}
    assert got == {"a_0.h5": "HONEST_UNKNOWN", "b_0.h5": "HIT", "c_0.h5": "CORRECT_REJECTION", "d_0.h5": "MISS_BELOW_FLOOR", "e_0.h5": "MISS_SUPPRESSED"}


def test_traffic_is_a_miss(spark):
    truth = spark.createDataFrame([("x", None, 2.0, 5)], "event_file string, verdict string, magnitude double, origin_ms bigint")
    best = spark.createDataFrame([("x", "FUENTE_MOVIL_TRAFICO")], "event_file string, classification string")
    assert scoring.outcomes(truth, best).first().outcome == "MISS_SUPPRESSED"


def crossings(spark, *curves):
    rows = [(f"a{k}", 1.0, s, 20, int(r * 20), r) for k, c in enumerate(curves) for s, r in c]
    return spark.createDataFrame(rows, "array_id string, updated double, snr double, n bigint, hits bigint, recall double")


def test_snr50_crosses_both_ways(spark):
    up, down, at, never, flat = [(1.0, 0.2), (2.0, 0.4), (3.0, 0.8)], [(1.0, 0.9), (2.0, 0.1), (3.0, 0.9)], [(1.0, 0.5), (2.0, 0.8)], [(1.0, 0.1), (2.0, 0.3)], [(1.0, 0.5), (2.0, 0.5), (4.0, 0.7)]
    got = {r.array_id: r.snr50 for r in scoring.snr50(crossings(spark, up, down, at, never, flat)).collect()}
    assert got == pytest.approx({"a0": 2.25, "a1": 1.5, "a2": 1.0, "a4": 2.0})


def test_recall_falls_beyond_the_intervals(spark):
    got = scoring.falling(crossings(spark, [(1.0, 0.1), (2.0, 1.0), (3.0, 0.2), (4.0, 0.3)], [(1.0, 0.5), (2.0, 0.45)])).collect()
    assert [(r.array_id, r.snr) for r in got] == [("a0", 2.0)]


def delays(spark, rows):
    return {(r.array, round(r.anchor_s, 6)): r.n for r in scoring.repeated_delays(spark.createDataFrame(rows, "array string, delay double")).collect()}


def test_delays_cluster_at_their_first_value(spark):
    rows = [("a", v) for v in (-3.05, -3.0, -3.02, 8.80, 8.85, 8.89, 8.95, 8.99, 8.99, 700.0, 700.05, 700.1, None, float("nan"), float("inf"))] + [("b", 1.0), ("b", 1.1), (None, 1.0)]
    # 8.95 is beyond the reach of 8.80 and starts a cluster of its own; 700.1 is just beyond that of 700
    assert delays(spark, rows) == {("a", -3.05): 3, ("a", 8.8): 3, ("a", 8.95): 3}


def test_delays_against_a_loop(spark):
    import random

    r = random.Random(3)
    rows = [("a", round(r.uniform(0, 6), 3)) for _ in range(400)]
    v, want, i = sorted(x for _, x in rows), {}, 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and v[j + 1] - v[i] <= 0.1:
            j += 1
        if j - i + 1 >= 3:
            want["a", round(v[i], 6)] = j - i + 1
        i = j + 1
    assert delays(spark, rows) == want


def test_scores_and_proposals(spark):
    base = [("a", f"f{k}", o) for k, o in enumerate(["MISS_BELOW_FLOOR", "MISS_BELOW_FLOOR", "HIT", "MISS_SUPPRESSED", "CORRECT_REJECTION"])] + [("b", "f9", "HIT")]
    new = {4.5: ["HIT", "HONEST_UNKNOWN", "MISS_BELOW_FLOOR", "MISS_SUPPRESSED", "CORRECT_REJECTION"], 5.0: ["HIT", "HIT", "HIT", "MISS_SUPPRESSED", "FALSE_ALARM"], 6.0: ["HIT", "MISS_BELOW_FLOOR", "HONEST_REGIONAL", "HIT", "CORRECT_REJECTION"], 7.0: ["HONEST_UNKNOWN", "HIT", "MISS_BELOW_FLOOR", "MISS_SUPPRESSED", "CORRECT_REJECTION"]}
    out = [("a", f"f{k}", c, o) for c, os in new.items() for k, o in enumerate(os)] + [("b", "f9", 4.5, "MISS_SUPPRESSED")]
    s = scoring.sweep_scores(spark.createDataFrame(out, "array string, event_file string, candidate double, outcome string"), spark.createDataFrame(base, "array string, event_file string, outcome string"))
    got = {(r.array, r.candidate): (r.changes, r.improves, r.worsens, r.downgrades, r.net, r.eligible) for r in s.collect()}
    assert got == {("a", 4.5): (3, 2, 0, 1, 1.5, True), ("a", 5.0): (3, 2, 1, 0, 0.0, False), ("a", 6.0): (3, 1, 0, 0, 1.0, True), ("a", 7.0): (3, 2, 0, 1, 1.5, True), ("b", 4.5): (1, 0, 1, 0, -2.0, False)}
    arrays = spark.createDataFrame([("a", 4.0), ("b", 4.0), ("c", 3.0)], "array string, now double")
    p = scoring.proposals(s, arrays, "tier0_threshold", F.col("now"))
    assert {(r.array, r.old_value, r.new_value, r.retained) for r in p.collect()} == {("a", 4.0, 4.5, False), ("b", 4.0, 4.0, True), ("c", 3.0, 3.0, True)}
    profiles = spark.createDataFrame([("a", '{"threshold": 4.0, "note": "x"}'), ("b", None), ("c", '{"threshold": 3.0}')], "array_id string, thresholds_json string")
    after = {r.array_id: r.thresholds_json for r in scoring.applied(profiles, p, "threshold").collect()}
    assert after["b"] is None and after["c"] == '{"threshold": 3.0}' and sorted(after["a"][1:-1].split(",")) == ['"note":"x"', '"threshold":"4.5"']


def test_choice_by_array(spark):
    rows = [("a", 0.05, REST[0], 3), ("a", 0.08, REST[1], 2), ("a", 0.2, REST[1], 9), ("b", 0.2, REST[0], 1)]
    flips = spark.createDataFrame(rows, "array string, candidate double, from_verdict string, n bigint")
    got = scoring.calibration_choice(flips, (0.05, 0.08, 0.2), ("array",)).collect()
    assert [(r.array, r.candidate, r.flips) for r in got] == [("a", 0.08, 2)]


def test_nearest_prototypes_in_blocks_and_scopes(spark):
    protos = spark.createDataFrame([("x", [1.0, 0.0], "a", 3), ("y", [0.0, 1.0], "b", 4), ("z", [2.0, 0.0], "b", 5)], "label string, proto array<double>, zone string, n_events bigint")
    sigs = spark.createDataFrame([(1, [3.0, 0.1], "a"), (2, [0.1, 3.0], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], "c"), (5, None, "a"), (6, [1.0, 1.0], None)], "id bigint, vec array<float>, zone string")
    free = {r.id: (r.label, r.recognised) for r in catalog.nearest_prototype(sigs, protos).collect()}
    assert free == {1: ("x", True), 2: ("y", True), 3: ("x", True), 4: ("x", True), 6: ("x", False)}  # ties: the least label
    assert {r.id: (r.label, r.recognised) for r in catalog.nearest_prototype(sigs, protos, block_rows=1).collect()} == free
    m = catalog.nearest_prototype(sigs, protos, scope="zone")
    assert {r.id: (r.label, r.recognised) for r in m.collect()} == {1: ("x", True), 2: ("x", False), 3: ("z", True)}
    assert {r.label: r.n_events for r in catalog.recounted(protos, m).collect()} == {"x": 4, "y": 4, "z": 6}
    assert catalog.nearest_prototype(sigs, protos.limit(0)).count() == 0


def test_naming(spark):
    clusters, protos = spark.createDataFrame([(1,), (2,), (3,)], "id bigint"), spark.createDataFrame([("old",)], "label string")
    wishes = spark.createDataFrame([(1, "new"), (2, "new"), (3, "old"), (9, "other")], "id bigint, label string")
    got = {r.id: r.state for r in catalog.named(clusters, wishes, protos).collect()}
    assert got == {1: "ok", 2: "label taken", 3: "label taken", 9: "no such cluster"}
