"""Problem 4: groups against brute force over all pairs."""

import numpy as np

from lumenarray.llm import mixture

SCHEMA = "id bigint, zone string, array_id string, dim int, vec array<float>, n_events int, first_seen double, last_seen double, source string, block int"


def clusters(spark, rows):
    return spark.createDataFrame([(i, z, "a", 64, v, n, 0.0, s, "clash", 1) for i, z, v, n, s in rows], SCHEMA)


def planted(sizes, noise, seed=1):
    r = np.random.default_rng(seed)
    rows, truth, i = [], {}, 0
    for k, n in enumerate(sizes):
        c = r.normal(size=64)
        for _ in range(n):
            v = (c + r.normal(size=64) * 0.25) * 10 ** r.uniform(-2, 2)
            rows.append((i, "km 1,5" if i % 2 else "KM1.50", v.astype(np.float32).tolist(), 2, float(i)))
            truth[i] = k
            i += 1
    for _ in range(noise):
        rows.append((i, None, r.normal(size=64).astype(np.float32).tolist(), 1, float(i)))
        i += 1
    return rows, truth


def test_pairs_whatever_the_chunks(spark):
    rows, truth = planted([40, 2, 3, 7, 2], 60)
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    bad = [(900, None, None, 1, 1.0), (901, None, [0.0] * 64, 1, 1.0), (902, None, [1.0] * 63, 1, 1.0), (903, None, [float("nan")] * 64, 1, 1.0), (None, None, [1.0] * 64, 1, 1.0)]
    df = clusters(spark, rows + rows[:5] + bad)
    for k in ({}, {"leaf_rows": 40, "fanout": 4}, {"leaf_rows": 25, "fanout": 3, "sample_rows": 50}):  # a source in many leaves is one source
        got = {(r.id_a, r.id_b) for r in mixture.pairs(mixture.sources(df, **k)).collect()}
        assert got == want, k


def test_latest_export_and_description(spark):
    v = [float(x) for x in range(1, 65)]
    df = clusters(spark, [(1, "km 2.5", v, 3, 1.0), (1, "km 2.5", v, 5, 2.0), (2, "KM 2,5", [2 * x for x in v], 7, 1.0), (3, None, v, None, None)])
    r = mixture.described(mixture.sources(df)).collect()
    assert len(r) == 1 and (r[0].size, r[0].n_events, r[0].zones, sorted(r[0].typical)) == (3, 12, ["km 2.5"], [1, 2, 3])


def test_empty_and_alone(spark):
    assert mixture.sources(clusters(spark, [])).count() == 0
    one = mixture.sources(clusters(spark, [(5, None, [1.0] * 64, 1, 1.0)]))
    assert [(r.id, r.source) for r in one.collect()] == [(5, 5)]
    assert mixture.pairs(one).count() == 0


def test_rounds_join_what_leaves_keep_apart(spark):
    rows, truth = planted([2] * 20 + [5], 20, seed=3)
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    got = {(r.id_a, r.id_b) for r in mixture.pairs(mixture.sources(clusters(spark, rows), leaf_rows=30, fanout=3, routes=1)).collect()}
    assert len(got & want) >= 0.95 * len(want) and got <= want


def test_one_source_of_a_third_of_all_rows(spark):
    rows, truth = planted([60, 3, 2], 40, seed=5)
    same = rows[0][2]
    rows = [(i, z, same, n, s) if truth.get(i) == 0 else (i, z, v, n, s) for i, z, v, n, s in rows]  # no mixture divides it
    got = {r.id: r.source for r in mixture.sources(clusters(spark, rows), leaf_rows=16, fanout=4).collect()}
    assert len({got[i] for i in truth if truth[i] == 0}) == 1 and len(got) == 105


def test_fine_mixture_needs_no_cosine():
    r = np.random.default_rng(6)
    rows, truth = planted([30, 12, 5, 3, 2, 2, 2], 300, seed=7)
    u = np.array([v for _, _, v, _, _ in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c, _ = mixture.fine_mixture(mixture.reducer(u.mean(0), np.cov(u.T))(u))
    groups = {frozenset(np.flatnonzero(c == k).tolist()) for k in range(c.max() + 1)} - {frozenset()}
    assert groups == {frozenset(i for i in truth if truth[i] == k) for k in range(7)}
    noise = r.normal(size=(500, 40)).astype(np.float32)
    assert (mixture.fine_mixture(noise)[0] == -1).all()


def test_coarse_components_follow_the_criterion():
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(200, 6)) * 0.3 + 6 * np.eye(6)[k] for k in range(6)]).astype(np.float32)
    weight, means, _ = mixture.coarse_model(x, 1200, 1200, 64, 1, 3)
    assert len(weight) == len(means) <= 8  # at least two are asked for; few more pay
    a, b = (mixture.coarse_fit(x, k, 3)[3] for k in (2, 6))
    assert b < a


def test_members_and_representatives(spark):
    rows, truth = planted([7, 4], 10, seed=9)
    got = mixture.sources(clusters(spark, rows)).collect()
    assert len(got) == 21 and {r.source for r in got} <= {r.id for r in got if r.id == r.source}
    assert len({r.source for r in got}) == 12
