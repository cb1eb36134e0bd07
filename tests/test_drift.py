"""Problem 2 on small fixtures."""

import datetime
import itertools
import json

import numpy as np

from lumenarray.operators import drift

RAW = "series string, run_no int, result_file string, line_no int, ingested_at timestamp_ntz, line string, field string, type string"
T = datetime.datetime(2013, 1, 1)


def raw(spark, rows):
    return spark.createDataFrame([(s, n, f"{s}_{n}", i, T, t, "clash", "clash") for s, n, i, t in rows], RAW)


def changes(spark, rows):
    return {(r.result_file, r.field, r.change_kind) for r in drift.changes(raw(spark, rows)).collect()}


def line(k, **x):
    return json.dumps({"event_id": f"e{k}", **x})


def test_kinds_of_change(spark):
    rows = [("s", 1, k, line(k, semblance=0.1 * k, phases={"t": 1}, a="one")) for k in range(1, 9)]
    rows += [("s", 4, k, line(k, semblance_peak=0.1 * k + 0.01, phases=[{"t": 1}], b=True)) for k in range(1, 9)]
    rows += [("s", 4, 1, line(1, semblance_peak=0.11, phases=[{"t": 1}], b=True))]  # read twice
    assert changes(spark, rows) == {("s_4", "semblance_peak", "renamed"), ("s_4", "phases", "retyped"), ("s_4", "a", "removed"), ("s_4", "b", "added")}


def test_broken_lines_marks_and_nulls(spark):
    rows = [("s", 1, 1, "﻿" + line(1, v=None, w=1)), ("s", 1, 2, line(2, v=None)[:9]), ("s", 1, 3, ""), ("s", 1, 4, None), ("s", 1, 5, "[1]")]
    rows += [("s", 2, 1, line(1, v=3, w=1.5)), (None, 2, 1, line(1)), ("t", 7, 1, line(1, only=1)), ("t", 8, 1, "broken")]
    # nothing but nulls before has no type to differ from; 1 and 1.5 are both numbers
    assert changes(spark, rows) == set()


def test_empty(spark):
    assert changes(spark, []) == set()


def test_matching_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in itertools.product((1, 2, 3, 4), (1, 2, 4)):
        s = rng.random((n, m))
        best = max(sum(s[i, j] for i, j in zip(rows, cols, strict=True)) for rows in itertools.permutations(range(n), min(n, m)) for cols in itertools.permutations(range(m), min(n, m)))
        assert abs(sum(s[i, j] for i, j in drift.matching(s)) - best) < 1e-9


def test_names():
    assert drift.words("vAppOnsetMps") == ["v", "app", "onset", "mps"]
    assert drift.name_similarity("track_r2", "trackR2") == 1
    assert drift.name_similarity("semblance", "operator_comment") < 0.4


def test_unified(spark):
    rows = [("s", 1, 1, line(1, classification="X", semblance=0.5, suppressed_false_positive=True, explanations=["a"], extra1=1))]
    rows += [("s", 2, 1, line(1, clasificacion="X", semblance="0.5", suppressed_false_positive=1, explanations="a", extra1=1))]
    rows += [("r", 1, k, line(k, classification="Y", semblance=0.5)) for k in range(3)]
    got = {(r.result_file, r.line_no): r for r in drift.unified(raw(spark, rows)).collect()}
    for key in (("s_1", 1), ("s_2", 1)):
        r = got[key]
        assert (r.classification, r.semblance, r.suppressed_false_positive, r.explanations, r.extra) == ("X", 0.5, True, ["a"], {"extra1": "1"})
    assert got["r_1", 0].semblance == 0.5 and got["r_1", 0].v_app_onset_mps is None


def test_a_rename_holds_in_its_series_only(spark):
    # u -> v in one series and v -> w in another must not make u and w one column
    rows = [("s", n, k, line(k, **{name: f"word{k % 3}", "classification": "X"})) for n, name in ((1, "peak_label"), (2, "peak_labels")) for k in range(6)]
    rows += [("t", n, k, line(k, **{name: f"word{k % 3}", "classification": "X"})) for n, name in ((1, "peak_labels"), (2, "peaks_label_text")) for k in range(6)]
    rows += [("v", 1, k, line(k, clasificacion="Y")) for k in range(2)] + [("w", n, k, line(k, **{name: "Z"})) for n, name in ((1, "classification"), (2, "clasificacion")) for k in range(4)]
    got = drift.unified(raw(spark, rows)).collect()
    keys = {s: {k for r in got if r.series == s for k in r.extra} for s in "stvw"}
    assert len(keys["s"]) == 1 and len(keys["t"]) == 1 and keys["s"] | keys["t"] <= {"peak_label", "peak_labels", "peaks_label_text"}
    # a series that never had the column's own name takes it from those that renamed it
    assert {(r.series, r.classification) for r in got if r.series in "vw"} == {("v", "Y"), ("w", "Z")}


def test_two_fields_of_one_name_and_repeats(spark):
    rows = [("s", 1, k, line(k, semblance=0.5 + k)) for k in range(4)] + [("s", 2, k, line(k, semblance_peak=0.6 + k)) for k in range(4)]
    rows += [("s", 3, 0, line(0, semblance=1.5, semblance_peak=2.5))] * 2 + [("s", 3, 1, line(1, semblance=None, semblance_peak=2.5))]
    got = {(r.run_no, r.line_no): r for r in drift.unified(raw(spark, rows)).collect()}
    assert len(got) == 10 and got[2, 1].semblance == 1.6 and got[3, 0].semblance == 1.5 and got[3, 1].semblance == 2.5


def test_unified_against_a_loop(spark):
    from lumenarray.session import table

    t = table(spark, "/root/testdata/sf0.001", "resultados_raw")
    want = {}
    for r in t.filter("series is not null and run_no is not null and result_file is not null and line is not null").collect():
        text = r.line[r.line.find("{") :] if "{" in r.line else ""
        try:
            d = json.loads(text)
        except ValueError:
            continue
        if isinstance(d, dict):
            want[r.series, r.run_no, r.result_file, r.line_no, text] = d
    got = drift.unified(t).collect()
    assert len(got) == len(want)
    plain = {(k[0], k[1], k[2], k[3]): d for k, d in want.items()}
    for r in got:
        d = plain[r.series, r.run_no, r.result_file, r.line_no]
        for c in ("event_id", "classification"):
            if isinstance(d.get(c), str):
                assert getattr(r, c) == d[c]
        if isinstance(d.get("semblance"), float):
            assert r.semblance == d["semblance"]
        assert not set(r.extra) & set(drift.KNOWN)
