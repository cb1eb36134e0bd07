"""Problem 4: groups of mutually similar signatures by Gaussian mixtures.

Signatures are brought to unit length, standardised and reduced by principal
components. A tree of coarse mixtures of bounded fan-out, each fitted by
expectation-maximisation on a bounded sample of its node, sends every row down
to the few leaves it fits best. In a leaf a fine mixture with regularised
diagonal covariance tells recurring sources from the broad background: an
information criterion decides which components there are, the posterior which
rows they own. A component's member of highest density represents it.

Representatives and rows of the background go through another round with other
trees, until a round joins next to nothing: that brings together the parts of
a source that lay in several leaves. The links of all rounds form components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarray.session import cut

DIM = 64
KEPT_VARIANCE = 0.95
FANOUT = 64  # coarse components of a node, at most
ROUTES = 2  # children a row is sent down to
LEAF_ROWS = 6_000  # rows a fine mixture, at most
SAMPLE_ROWS = 8_192  # rows a coarse mixture is fitted on, at most; all rows are routed
EM_ROUNDS = 6
PRIOR_ROWS, PRIOR_VARIANCE = 8.0, 0.2  # a component's variances are regularised as by so many rows
WIDEST = 0.5  # a source is narrower than this share of the background's variance
FLOOR = 1e-3  # least variance, in standardised units
SETTLED = 5e-4  # a round that joins a smaller share of its rows is the last
MOST_ROUNDS = 8


@dataclass
class Reducer:
    """Centre and matrix from unit vectors to standardised principal components."""

    mean: np.ndarray
    matrix: np.ndarray

    def __call__(self, units: np.ndarray) -> np.ndarray:
        return ((units - self.mean) @ self.matrix).astype(np.float32)


def reducer(mean: np.ndarray, cov: np.ndarray, kept: float = KEPT_VARIANCE) -> Reducer:
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, vectors = np.linalg.eigh(cov / np.outer(dev, dev))
    order = np.argsort(-values)
    share = np.cumsum(np.maximum(values[order], 0)) / max(np.maximum(values, 0).sum(), 1e-12)
    return Reducer(mean, vectors[:, order[: int(np.searchsorted(share, kept)) + 1]] / dev[:, None])


def log_densities(x: np.ndarray, means: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Of each row under each component of diagonal covariance, up to the
    constant that all share."""
    inv = 1 / var
    quad = (x * x) @ inv.T - 2 * (x @ (means * inv).T) + (means * means * inv).sum(1)
    return -0.5 * (np.maximum(quad, 0) + np.log(var).sum(1))


def coarse_fit(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means and variances of a mixture of k components with a diagonal
    covariance that all share, regularised towards the whole sample's, and its
    BIC (less is better). Sharing it, and one length of all means,
    keeps the components of like size."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    means = x[rng.choice(n, k, replace=False)].astype(np.float64)
    whole = np.maximum(x.var(axis=0, dtype=np.float64), FLOOR)
    var, weight = np.tile(0.5 * whole, (k, 1)), np.full(k, 1 / k)
    for step in range(EM_ROUNDS + 1):
        log = np.log(weight) + log_densities(x, means, var)
        top = log.max(axis=1, keepdims=True)
        resp = np.exp(log - top)
        norm = resp.sum(axis=1, keepdims=True)
        if step == EM_ROUNDS:
            break
        resp /= norm
        mass = resp.sum(axis=0) + 1e-9
        means = resp.T @ x / mass[:, None]
        length = np.linalg.norm(means, axis=1, keepdims=True)
        means *= math.sqrt(float((mass[:, None] * length**2).sum()) / n) / np.maximum(length, 1e-9)
        within = np.maximum((x * x).sum(axis=0) - (mass[:, None] * means**2).sum(axis=0), 0)
        var = np.tile(np.maximum((within + PRIOR_ROWS * whole) / (n + PRIOR_ROWS), FLOOR), (k, 1))
        weight = (mass + 1) / (n + k)
    likelihood = float((top[:, 0] + np.log(norm[:, 0])).sum())
    return weight, means, var, -2 * likelihood + (k * (d + 1) + d - 1) * math.log(n)


def coarse_model(x: np.ndarray, n: int, leaf_rows: int, fanout: int, routes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coarse mixture of a node of n rows, fitted on its sample x: the best
    by BIC of those with enough components to come near leaves of leaf_rows
    rows (as many as the fan-out allows)."""
    least = max(2, min(fanout, len(x), math.ceil(1.5 * routes * n / leaf_rows)))
    fits = [coarse_fit(x, k, seed) for k in sorted({least, min(len(x), fanout, 2 * least)})]
    return min(fits, key=lambda f: f[3])[:3]


def routed(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray], routes: int) -> np.ndarray:
    """The components of greatest posterior of each row."""
    weight, means, var = model
    log = np.log(weight) + log_densities(x, means, var)
    r = min(routes, len(weight))
    return np.argpartition(-log, r - 1, axis=1)[:, :r]


def kernel_links(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, other) and the log likelihood ratio of the row: a component
    round the other, as wide as their distance says (no wider than WIDEST),
    against the background; only ratios above `least`."""
    n, d = x.shape
    half = (0.5 * (x.astype(np.float64) ** 2).sum(1)).astype(np.float32)
    one = np.ones(n, np.float32)
    # one product gives minus half the squared distance
    left, right = np.column_stack([x, half, one]), np.column_stack([x, -one, -half]).T.copy()
    rows, others, ratios = [], [], []
    for a in range(0, n, 512):
        close = left[a : a + 512] @ right
        i, j = np.nonzero(close > -WIDEST * d)  # beyond, the background is as good
        distance = np.maximum(-2 * close[i, j].astype(np.float64), 0)
        i += a
        v = np.clip(distance / d, 0.02, WIDEST)
        ratio = half[i] - 0.5 * (distance / v + d * np.log(v))
        keep = (ratio > least) & (i != j)
        rows.append(i[keep])
        others.append(j[keep])
        ratios.append(ratio[keep])
    return np.concatenate(rows), np.concatenate(others), np.concatenate(ratios)


def fine_mixture(x: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Component of each row of a leaf, -1 for the background, and its density there.

    The background is the standard normal of the standardised features. Each
    component starts from an exemplar row: the densest row that no component
    explains yet, with the rows likelier there than in the background. After
    expectation-maximisation a component stays if the gain in likelihood of its
    other rows exceeds BIC's price of log n for which row is the exemplar and
    half of log n each for weight and width. Rows that the mixture leaves to
    the background may start further components, until none pays.
    """
    n, d = x.shape
    price = 2 * math.log(max(n, 2))
    component, density = np.full(n, -1), np.zeros(n)
    if n < 2:
        return component, density
    pull = math.log(2 / n)  # of a component of two rows, the least there is
    row, other, ratio = kernel_links(x, -pull)
    # rows without such a link are background whatever the components
    linked = np.unique(np.concatenate([row, other]))
    if not len(linked):
        return component, density
    place = np.zeros(n, np.int64)
    place[linked] = np.arange(len(linked))
    found, dense = _fitted(x[linked], n, place[row], place[other], ratio, pull, price, rounds)
    component[linked], density[linked] = found, dense
    return component, density


def _fitted(x: np.ndarray, n_all: int, row: np.ndarray, other: np.ndarray, ratio: np.ndarray, pull: float, price: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """fine_mixture of the linked rows of a leaf of n_all rows."""
    n, d = x.shape
    component, density = np.full(n, -1), np.zeros(n)
    background = -0.5 * (x**2).sum(1, dtype=np.float64)
    means, var, mass = np.zeros((0, d)), np.zeros((0, d)), np.zeros(0)
    free = np.ones(n, bool)
    while True:
        live = free[row] & free[other] & (ratio + pull > price)
        support = np.bincount(other[live], weights=ratio[live], minlength=n)
        order = np.argsort(other[live], kind="stable")
        to, begin = row[live][order], np.searchsorted(other[live][order], np.arange(n + 1))
        seeds, taken = [], ~free
        for i in np.argsort(-support, kind="stable").tolist():
            if support[i] <= 0:
                break
            if not taken[i]:
                mine = to[begin[i] : begin[i + 1]]
                mine = mine[~taken[mine]]
                if len(mine):
                    seeds.append((i, mine))
                    taken[i] = True
                    taken[mine] = True
        if not seeds:
            break
        first = np.stack([x[[i, *m.tolist()]].mean(axis=0) for i, m in seeds])
        means = np.concatenate([means, first])
        var = np.concatenate([var, np.full((len(seeds), d), PRIOR_VARIANCE)])
        mass = np.concatenate([mass, [1.0 + len(m) for _, m in seeds]])
        for step in range(rounds + 1):
            log = np.log(mass / n_all) + log_densities(x, means.astype(np.float32), var.astype(np.float32))
            floor = math.log(max(1 - mass.sum() / n_all, 1 / n_all)) + background
            top = np.maximum(log.max(axis=1), floor)
            resp = np.exp(log - top[:, None])
            resp /= (resp.sum(axis=1) + np.exp(floor - top))[:, None]
            if step == rounds:
                break
            gains = resp * np.maximum(log - floor[:, None], 0)
            pays = gains.sum(axis=0) - gains.max(axis=0) > price
            resp, means, var = resp[:, pays], means[pays], var[pays]
            mass = resp.sum(axis=0)
            if not len(mass):
                break
            resp = resp.astype(np.float32)
            means = resp.T @ x / mass[:, None]
            spread = np.maximum(resp.T @ (x * x) / mass[:, None] - means**2, 0)
            # the few rows of a source hold its variance; its shape is regularised by its mean width
            round_ = spread.mean(axis=1, keepdims=True)
            var = np.clip((mass[:, None] * (0.5 * spread + 0.5 * round_) + PRIOR_ROWS * PRIOR_VARIANCE) / (mass[:, None] + PRIOR_ROWS), FLOOR, WIDEST)
        if not len(mass):
            component[:] = -1
            break
        best = log.argmax(axis=1)
        density = log[np.arange(n), best]
        component = np.where(density > floor, best, -1)
        still = component < 0
        if still.sum() == free.sum():
            break
        free = still
    return component, density


def represented(ids: np.ndarray, units: np.ndarray, reduce: Reducer, least_cosine: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(member, representative) of a leaf: each component's member of highest
    density (ties: the least id). With least_cosine, links below it fall away."""
    order = np.argsort(ids, kind="stable")
    ids, units = ids[order], units[order]
    component, density = fine_mixture(reduce(units))
    rows = np.flatnonzero(component >= 0)
    rows = rows[np.lexsort((rows, -np.round(density[rows], 6), component[rows]))]
    first = np.flatnonzero(np.diff(component[rows], prepend=-1))
    rep = rows[np.repeat(first, np.diff(np.append(first, len(rows))))]
    keep = rows != rep
    if least_cosine is not None:
        keep &= (units[rows].astype(np.float64) * units[rep]).sum(axis=1) >= least_cosine
    return ids[rows[keep]], ids[rep[keep]]


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a column of equally long lists."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)


def usable(clusters: DataFrame) -> DataFrame:
    """One row per id with a usable vector, brought to unit length (u): the
    export with the latest last_seen, then the greatest n_events. Null, zero,
    short, long and non-finite vectors and null ids are left out."""
    fine = F.size("vec") == DIM
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = clusters.filter("id is not null and vec is not null").filter(fine).filter(finite)
    rest = [F.col(c) for c in ("n_events", "zone", "array_id")]
    latest = F.struct(F.coalesce("last_seen", F.lit(float("-inf"))), F.coalesce("n_events", F.lit(-1)), F.col("vec"))
    one = rows.groupBy("id").agg(F.max_by(F.struct("vec", *rest), latest).alias("r")).select("id", "r.n_events", "r.zone", "r.array_id", F.col("r.vec").alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix_of(b.column("u")).astype(np.float64)
            x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            u = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, DIM, dtype=np.int32)), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "n_events", "zone", "array_id")), u], ["id", "n_events", "zone", "array_id", "u"])

    types = dict(clusters.dtypes)
    return one.mapInArrow(run, f"id {types['id']}, n_events {types['n_events']}, zone string, array_id string, u array<float>")


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of the unit vectors, over all rows."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(DIM), np.zeros((DIM, DIM))
        for b in batches:
            x = matrix_of(b.column("u")).astype(np.float64)
            n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        flat = np.concatenate([[n], total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["place", "value"])

    got = rows.select("u").mapInArrow(part, "place int, value double").groupBy("place").agg(F.sum("value").alias("v")).orderBy("place").collect()
    flat = np.array([r.v for r in got]) if got else np.zeros(1 + DIM + DIM * DIM)
    n = int(flat[0])
    mean = flat[1 : DIM + 1] / max(n, 1)
    return n, mean, flat[DIM + 1 :].reshape(DIM, DIM) / max(n, 1) - np.outer(mean, mean)


@dataclass
class Tree:
    """Coarse mixtures by node (0 is the root); a child's number is its
    parent's times the fan-out, plus its place from 1 on. parts: leaves that
    no mixture divides, which are cut by a hash."""

    reduce: Reducer
    fanout: int
    routes: int
    models: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    parts: dict[int, int]

    def down(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each row in the leaves it fits best."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        done_rows, done_nodes = [], []
        while len(row):
            new_rows, new_nodes = [], []
            for k in np.unique(node).tolist():
                mine = row[node == k]
                if k in self.models:
                    to = routed(x[mine], self.models[k], self.routes)
                    new_rows.append(np.repeat(mine, to.shape[1]))
                    new_nodes.append(k * self.fanout + 1 + to.ravel().astype(np.int64))
                else:
                    done_rows.append(mine)
                    done_nodes.append(np.full(len(mine), k, np.int64))
            row, node = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (new_rows, new_nodes))
        return (np.concatenate(done_rows), np.concatenate(done_nodes)) if done_rows else (row, node)


def spread_ids(ids: np.ndarray, seed: int) -> np.ndarray:
    """A hash of ids, between 0 and 1."""
    h = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def grown(rows: DataFrame, reduce: Reducer, leaf_rows: int, fanout: int, routes: int, sample_rows: int, seed: int) -> Tree:
    """A tree whose leaves have at most leaf_rows rows, or can't be divided.

    Level by level all rows are counted by node; nodes that are too large get a
    mixture fitted on about sample_rows of their rows, each in a task. Only
    counts and mixtures come to the driver: a mixture (fan-out x dimensions)
    for each 64 leaves or so.
    """
    spark = rows.sparkSession
    tree = Tree(reduce, fanout, routes, {}, {})
    sizes: dict[int, int] = {}
    while True:
        held = spark.sparkContext.broadcast(tree)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, leaf = held.value.down(held.value.reduce(matrix_of(b.column("u"))))
                leaf, n = np.unique(leaf, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n.astype(np.int64))], ["node", "n"])

        now = {r.node: r.n for r in rows.select("u").mapInArrow(count, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).collect()}
        sizes.update(now)
        split = {}
        for node, n in now.items():
            if n > leaf_rows:
                if node and n > 0.9 * sizes[(node - 1) // fanout]:  # as good as one point
                    tree.parts[node] = math.ceil(n / leaf_rows)
                else:
                    split[node] = n
        if not split:
            return tree
        wanted = spark.sparkContext.broadcast(split)

        def sample(batches: Iterator[pa.RecordBatch], held=held, wanted=wanted) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = held.value.reduce(matrix_of(b.column("u")))
                row, leaf = held.value.down(x)
                share = np.array([sample_rows / wanted.value.get(k, math.inf) for k in leaf.tolist()])
                keep = spread_ids(b.column("id").to_numpy()[row], seed) < share
                yield pa.RecordBatch.from_arrays([pa.array(leaf[keep]), b.column("id").take(pa.array(row[keep])), pa.array(list(x[row[keep]]), pa.list_(pa.float32()))], ["node", "id", "x"])

        def fit(group: pa.Table) -> pa.Table:
            node = group.column("node")[0].as_py()
            x = np.stack(group.sort_by("id").column("x").to_numpy())
            weight, means, var = coarse_model(x, wanted.value[node], leaf_rows, fanout, routes, seed)
            return pa.table({"node": [node], "weight": [weight.tolist()], "means": [means.ravel().tolist()], "var": [var[0].tolist()]})

        fits = rows.select("id", "u").mapInArrow(sample, "node bigint, id bigint, x array<float>").groupBy("node").applyInArrow(fit, "node bigint, weight array<double>, means array<double>, var array<double>").collect()
        for r in fits:
            means = np.array(r.means).reshape(len(r.weight), -1)
            tree.models[r.node] = np.array(r.weight), means, np.tile(np.array(r.var), (len(means), 1))
        for node in split.keys() - {r.node for r in fits}:  # so few rows fell into its sample
            tree.parts[node] = math.ceil(split[node] / leaf_rows)


def leaf_links(rows: DataFrame, tree: Tree, seed: int, least_cosine: float | None) -> DataFrame:
    """Links (id, rep) found by the fine mixtures of a tree's leaves."""
    held = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        for b in batches:
            row, leaf = tree.down(tree.reduce(matrix_of(b.column("u"))))
            parts = np.array([tree.parts.get(k, 1) for k in leaf.tolist()], np.int64)
            part = (spread_ids(b.column("id").to_numpy()[row], seed + 1) * parts).astype(np.int32)
            # half floats on the way: a thousandth of a cosine, in half the space
            u = matrix_of(b.column("u")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(part), b.column("id").take(pa.array(row)), pa.array([u[k].tobytes() for k in row.tolist()], pa.binary())], ["leaf", "part", "id", "u"])

    def fine(group: pa.Table) -> pa.Table:
        u = np.frombuffer(b"".join(group.column("u").to_pylist()), np.float16).reshape(-1, DIM).astype(np.float32)
        id_, rep = represented(group.column("id").to_numpy(), u, held.value.reduce, least_cosine)
        return pa.table({"id": pa.array(id_, pa.int64()), "rep": pa.array(rep, pa.int64())})

    return rows.select("id", "u").mapInArrow(run, "leaf bigint, part int, id bigint, u binary").groupBy("leaf", "part").applyInArrow(fine, "id bigint, rep bigint")


def components(links: DataFrame) -> DataFrame:
    """id, source: connected components of the links (id, rep), each named by
    the representative of most links (ties: the least id).

    Rows that have several representatives join them; the labels of these few
    links are propagated until nothing changes, with the lineage cut.
    """
    ends = links.groupBy("id").agg(F.min("rep").alias("least"))
    reps = links.groupBy(F.col("rep").alias("a")).agg(F.count("*").alias("n"))
    edges = links.join(ends, "id").filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).unionByName(links.select(F.col("id").alias("a"), F.col("rep").alias("b")).join(reps.select("a"), "a"))
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(reps.withColumn("source", F.col("a")))
    while True:
        heard = both.join(label.select(F.col("a").alias("b"), "source"), "b").groupBy("a").agg(F.min("source").alias("heard"))
        # a label jumps to the label of its own name too, which halves chains
        new = label.join(heard, "a", "left").withColumn("source", F.least("source", F.coalesce("heard", "source"))).drop("heard")
        hop = new.select(F.col("a").alias("source"), F.col("source").alias("hop"))
        new = cut(new.join(hop, "source").select("a", "n", F.col("hop").alias("source")))
        same = new.join(label.select("a", F.col("source").alias("was")), "a").filter("source <> was").isEmpty()
        label = new
        if same:
            break
    name = label.groupBy("source").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("name"))
    named = label.join(name, "source").select("a", F.col("name").alias("source"))
    members = ends.join(named.select(F.col("a").alias("least"), "source"), "least").select("id", "source")
    return members.join(named.select(F.col("a").alias("id")), "id", "left_anti").unionByName(named.select(F.col("a").alias("id"), "source"))


def sources(clusters: DataFrame, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT, routes: int = ROUTES, sample_rows: int = SAMPLE_ROWS, least_cosine: float | None = None) -> DataFrame:
    """id, source, u, n_events, zone, array_id of every usable signature.

    source is the id of the group's representative; a signature like no other
    has a group of its own. Empty input gives no rows. A source that owns a
    large share of all rows is cut by a hash where no mixture divides it, and
    its parts meet again as representatives. least_cosine: links of a member
    to a representative below this cosine are dropped (a check of the
    mixture's links; it adds none).
    """
    rows = cut(usable(clusters))
    n, mean, cov = moments(rows)
    if not n:
        return rows.select("id", F.col("id").alias("source"), "u", "n_events", "zone", "array_id")
    reduce = reducer(mean, cov)
    todo, links = rows.select("id", "u"), None
    for k in range(MOST_ROUNDS):
        got = cut(leaf_links(todo, grown(todo, reduce, leaf_rows, fanout, routes, sample_rows, 7919 * k), 7919 * k, least_cosine))
        links = got if links is None else links.unionByName(got)
        gone = got.select("id").distinct().join(got.select(F.col("rep").alias("id")).distinct(), "id", "left_anti")
        joined = gone.count()
        if joined <= SETTLED * n and k:
            break
        todo = cut(todo.join(gone, "id", "left_anti"))
        n -= joined
    labels = components(links.distinct())
    return rows.join(labels, "id", "left").select("id", F.coalesce("source", "id").alias("source"), "u", "n_events", "zone", "array_id")


def pairs(labelled: DataFrame, salts: int = 16) -> DataFrame:
    """id_a < id_b of one source. The many pairs of a large source are spread
    over `salts` parts by their first id."""
    some = labelled.groupBy("source").count().filter("count > 1").select("source")
    d = cut(labelled.select("source", "id").join(some, "source"))
    left = d.select("source", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    right = d.select("source", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    return left.join(right, ["source", "salt"]).filter("id_a < id_b").select("id_a", "id_b")


def clean_zone(zone):
    """A zone in one spelling: lower case, decimal point, no blanks, one decimal."""
    z = F.regexp_replace(F.regexp_replace(F.lower(F.trim(zone)), ",", "."), r"\s+", "")
    km = F.regexp_extract(z, r"^km([0-9]+(?:\.[0-9]+)?)$", 1).try_cast("double")
    return F.coalesce(F.when(km.isNotNull(), F.format_string("km %.1f", km)), F.nullif(z, F.lit("")))


def described(labelled: DataFrame, typical: int = 3, part_rows: int = 4_096) -> DataFrame:
    """Each source by its size, events, zones and most typical signatures.

    source, size, n_events, zones (in one spelling, sorted), typical (ids of
    the signatures nearest by cosine to the source's mean direction; ties take
    the least id). A source goes to as many parts as its size asks for.
    """
    centre = labelled.groupBy("source").agg(F.array(*(F.avg(F.col("u")[i]) for i in range(DIM))).alias("centre"), F.ceil(F.count("*") / part_rows).alias("parts"))
    like = F.aggregate(F.zip_with("u", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    near = labelled.join(centre, "source").select("source", "parts", "n_events", "zone", F.struct(F.round(-like, 9).alias("far"), "id").alias("m"))
    w = near.groupBy("source", F.pmod(F.xxhash64("m.id"), F.col("parts")).alias("_s")).agg(F.count("*").alias("size"), F.sum("n_events").alias("n_events"), F.collect_set(clean_zone(F.col("zone"))).alias("zones"), F.slice(F.sort_array(F.collect_list("m")), 1, typical).alias("best"))
    return w.groupBy("source").agg(F.sum("size").alias("size"), F.sum("n_events").alias("n_events"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("zones")))).alias("zones"), F.transform(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, typical), lambda x: x["id"]).alias("typical"))
