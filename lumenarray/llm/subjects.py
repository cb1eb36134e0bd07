"""Problem 9: subjects of each document.

Sentences are embedded by term weighting and a truncated singular value
decomposition. Each subject starts from four seed centroids, the halves of halves
of its labelled documents' sentences and description along their main
directions (such as the languages); the centroids are refined by assigning those
sentences and averaging again. Every
sentence of the corpus goes to the nearest centroid by cosine, or to none, and
a document's sentences decide its subjects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarray.llm.text import ASIDE

SAMPLE = 4_000  # labelled documents that the model is fitted on, at most
RANK = 48
ROUNDS = 6
LEAST_SENTENCES, LEAST_SHARE = 2, 0.25
ABOUT = "doc_id bigint, subject string, sentences int, about_any int"

TOKEN = re.compile(r"[^\W\d_]{3,}|[.!?;](?=\s)")
ENDS = {mark: -2 for mark in ".!?;"}


@dataclass
class Model:
    terms: dict[str, int]  # with the sentence marks at -2
    weight: np.ndarray  # of each term; 0 for those that say nothing
    mark: np.ndarray  # random number of each term, summed to a sentence's signature
    vectors: np.ndarray  # weighted projection of each term
    subjects: list[str]
    centroids: np.ndarray  # up to four a subject, x rank
    owner: np.ndarray  # subject of each centroid
    stock: np.ndarray  # signatures of sentences that speeches share by custom
    least_cosine: float = 0.3
    least_weight: float = 0.1


def sentences(texts: list[str | None], terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts at once: known term numbers, the sentence of each, and the
    text of each sentence. Asides in brackets are left out."""
    split = [[*TOKEN.findall(ASIDE.sub(" ", t.lower())), "."] if t else ["."] for t in texts]
    ids = np.fromiter(map(terms.get, chain.from_iterable(split), repeat(-1)), np.int64)
    end = ids == -2
    of = np.cumsum(end) - end
    text_of = np.repeat(np.arange(len(texts)), [len(x) for x in split])[end]
    return ids[ids >= 0], of[ids >= 0], text_of


def sums(values: np.ndarray, of: np.ndarray, n: int, kind: type = np.float32) -> np.ndarray:
    """Sum of the rows of `values` by group; `of` is ascending."""
    out = np.zeros((n, *values.shape[1:]), kind)
    if len(of):
        start = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[start]] = np.add.reduceat(values, start, axis=0)
    return out


def weighted_sums(vectors: np.ndarray, ids: np.ndarray, of: np.ndarray, n: int, weight: np.ndarray | None = None, step: int = 50_000) -> np.ndarray:
    """Sum of vectors[ids] (times weight) by group, a step of rows at a time."""
    out = np.zeros((n, vectors.shape[1]), np.float32)
    for a in range(0, len(ids), step):
        part, group = vectors[ids[a : a + step]], of[a : a + step]
        if weight is not None:
            part = part * weight[a : a + step, None]
        start = np.flatnonzero(np.diff(group, prepend=-1))
        out[group[start]] += np.add.reduceat(part, start, axis=0)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def truncated_svd(ids: np.ndarray, of: np.ndarray, n: int, weight: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """Right singular vectors (terms x rank) of the weighted sentence-term
    matrix, by subspace iteration."""
    rank = min(rank, len(weight), n)
    q = np.random.default_rng(seed).normal(size=(len(weight), rank)).astype(np.float32)
    by_term = np.argsort(ids, kind="stable")
    w = weight[ids]
    for _ in range(5):
        y = weighted_sums(q, ids, of, n, w)
        z = weighted_sums(y, of[by_term], ids[by_term], len(weight), w[by_term])
        q = np.linalg.qr(z)[0].astype(np.float32)
    return q


def halves(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows on either side of their mean along the direction in which they
    differ most; all of them where that leaves a side with under three."""
    if len(rows) < 6:
        return [rows]
    centred = x[rows] - x[rows].mean(axis=0)
    side = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1] > 0
    return [rows[side], rows[~side]] if 3 <= side.sum() <= len(rows) - 3 else [rows]


def fit(texts: list[str], labels: list[set[str]], subjects: list[tuple[str, str]], frequency: dict[str, int], documents: int, rank: int = RANK) -> Model:
    """Model from labelled documents; frequency: documents of the whole corpus
    that hold each term. Without labelled documents the descriptions are all."""
    names = [s for s, _ in subjects]
    number = {s: i for i, s in enumerate(names)}
    described = [(s, t) for s, t in subjects if t]
    terms = {w: i for i, w in enumerate(sorted(frequency))}
    n_terms, n_texts, k_all = len(terms), len(texts), len(names)
    ids, of, text_of = sentences([*texts, *(t for _, t in described)], terms | ENDS)
    n = len(text_of)
    truth = np.zeros((n_texts + len(described), k_all), bool)
    for d, lab in enumerate([*labels, *({s} for s, _ in described)]):
        truth[d, [number[s] for s in lab if s in number]] = True
    mark = np.random.default_rng(11).integers(1, 2**62, max(1, n_terms))
    # sentences that documents of many subjects share are custom, not content
    with np.errstate(over="ignore"):
        signature = sums(mark[ids] if n_terms else np.zeros(0, np.int64), of, n, np.int64)
    spread: dict[int, tuple[set, set]] = {}
    for g, d in zip(signature.tolist(), text_of.tolist(), strict=True):
        if g and d < n_texts:
            docs, subs = spread.setdefault(g, (set(), set()))
            docs.add(d)
            subs.update(np.flatnonzero(truth[d]).tolist())
    least = max(3, n_texts // 500)
    stock = np.sort(np.array([g for g, (docs, subs) in spread.items() if len(docs) >= least and len(subs) >= min(4, k_all)], np.int64))
    live = ~np.isin(signature, stock)[of] if n else np.zeros(0, bool)
    ids, of = ids[live], of[live]
    # a term's weight: its rarity in the corpus times how far its labelled documents lean to a subject
    pair = np.unique(text_of[of] * max(1, n_terms) + ids)
    share_of = truth / np.maximum(truth.sum(1, keepdims=True), 1)
    lean = np.zeros((n_terms, k_all))
    pair = pair[pair // max(1, n_terms) < n_texts]
    np.add.at(lean, pair % max(1, n_terms), share_of[pair // max(1, n_terms)])
    seen = lean.sum(1)
    prior = (lean.sum(0) + 1) / (lean.sum() + max(1, k_all))
    share = (lean + 2 * prior) / (seen + 2)[:, None]
    focus = (share * np.log(share / prior)).sum(1) / np.log(max(k_all, 2))
    focus[seen < 2] = 0
    rare = np.log((documents + 1) / (np.array([frequency[w] for w in terms]) + 1)).clip(0) if terms else np.zeros(0)
    weight = (np.clip(focus, 0, 1) ** 1.5 * rare / max(np.log(documents + 1), 1)).astype(np.float32)
    model = Model(terms | ENDS, weight, mark, np.zeros((n_terms, 1), np.float32), names, np.zeros((0, 1), np.float32), np.zeros(0, int), stock)
    ids, of = ids[weight[ids] > 0], of[weight[ids] > 0]
    if not len(ids):
        return model
    rank = min(rank, max(len(names), int((weight > 0).sum()) // 4))  # fewer than the terms, that like ones share directions
    model.vectors = truncated_svd(ids, of, n, weight, rank) * weight[:, None]
    x, strength = unit(weighted_sums(model.vectors, ids, of, n)), sums(weight[ids], of, n)
    allowed = truth[text_of]
    # seeds: sentences of documents with one subject, in quarters; refined by assignment
    take, owner = [], []
    for k in range(k_all):
        rows = np.flatnonzero(allowed[:, k] & (allowed.sum(1) == 1) & (strength > 0))
        for half in halves(x, rows):
            for part in halves(x, half):
                take.append(part)
                owner.append(k)
    for _ in range(ROUNDS + 1):
        kept = [(rows, k) for rows, k in zip(take, owner, strict=True) if len(rows)]
        if not kept:
            return model
        owner = np.array([k for _, k in kept])
        model.centroids, model.owner = unit(np.array([(x[rows] * strength[rows, None]).sum(0) for rows, _ in kept], np.float32)), owner
        cosine = x @ model.centroids.T
        best = cosine.argmax(1)
        top = cosine[np.arange(n), best]
        sure = (top >= 0.4) & (strength > 0) & allowed[np.arange(n), owner[best]]
        take = [np.flatnonzero(sure & (best == c)) for c in range(len(owner))]
    # the bounds for "about a subject": the best over the labelled documents, the strictest of equals
    inside, best_score = text_of < n_texts, -1.0
    for least_cosine in (0.6, 0.5, 0.4, 0.3):
        for least_weight in (0.3, 0.25, 0.2, 0.15, 0.1, 0.05):
            on = inside & (top >= least_cosine) & (strength >= least_weight)
            counts = np.zeros((n_texts, k_all), int)
            np.add.at(counts, (text_of[on], model.owner[best[on]]), 1)
            said = decide(counts)
            score = 2 * (said & truth[:n_texts]).sum() / max(1, said.sum() + truth[:n_texts].sum())
            if score > best_score + 0.002:
                best_score, model.least_cosine, model.least_weight = score, least_cosine, least_weight
    return model


def decide(counts: np.ndarray) -> np.ndarray:
    """Subjects of documents from their sentences by subject."""
    return (counts >= LEAST_SENTENCES) & (counts >= LEAST_SHARE * counts.sum(1, keepdims=True))


def count_sentences(model: Model, texts: list[str | None]) -> np.ndarray:
    """Sentences about each subject (documents x subjects)."""
    counts = np.zeros((len(texts), len(model.subjects)), int)
    if not len(model.centroids):
        return counts
    ids, of, text_of = sentences(texts, model.terms)
    n = len(text_of)
    with np.errstate(over="ignore"):
        signature = sums(model.mark[ids], of, n, np.int64)
    telling = model.weight[ids] > 0
    ids, of = ids[telling], of[telling]
    strength = sums(model.weight[ids], of, n)
    on = np.flatnonzero((strength >= model.least_weight) & ~np.isin(signature, model.stock))
    x = unit(weighted_sums(model.vectors, ids, of, n)[on])
    cosine = x @ model.centroids.T
    best = cosine.argmax(1)
    sure = cosine[np.arange(len(on)), best] >= model.least_cosine
    np.add.at(counts, (text_of[on[sure]], model.owner[best[sure]]), 1)
    return counts


def document_frequency(documents: DataFrame, terms: set[str]) -> tuple[dict[str, int], int]:
    """Documents of the corpus that hold each of the terms, and the number of
    documents: a statistic of all documents, for as many terms as are given."""
    spark = documents.sparkSession
    d = documents.filter("text is not null")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), F.lit(1)))
    known = spark.createDataFrame([(t,) for t in sorted(terms)], "term string")
    found = d.select(F.explode(words).alias("term")).join(F.broadcast(known), "term").groupBy("term").count()
    return {r[0]: r[1] for r in found.collect()}, d.count()


def telling_terms(texts: list[str]) -> set[str]:
    """The terms of the labelled texts; no others can lean to a subject."""
    return {w for t in texts for w in TOKEN.findall(ASIDE.sub(" ", t.lower())) if w not in ENDS}


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> Model:
    """Fit on at most `sample` labelled documents, chosen by a hash of their id.
    The vocabulary is theirs and the descriptions', so `sample` bounds it too
    (and what is broadcast to count its terms in all documents)."""
    chosen = labels.dropna().groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = chosen.join(documents.select("doc_id", "text"), "doc_id").filter("text is not null").orderBy("doc_id").collect()
    topics = [tuple(r) for r in subjects.filter("subject is not null").groupBy("subject").agg(F.max("description")).orderBy("subject").collect()]
    terms = telling_terms([r["text"] for r in rows]) | {w for _, t in topics if t for w in TOKEN.findall(t.lower()) if w not in ENDS}
    frequency, n = document_frequency(documents, terms)
    return fit([r["text"] for r in rows], [set(r["subjects"]) for r in rows], topics, frequency, n, rank)


def assign(documents: DataFrame, model: Model) -> DataFrame:
    """Subjects of each document (ABOUT): one row per document and subject that
    takes at least two sentences and a quarter of those about any subject.

    Null and empty texts and documents without a subject give no row; rows
    with a null doc_id are left out; a doc_id posted twice gives equal rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            ids, texts = b["doc_id"].to_numpy(), b["text"].tolist()
            for a in range(0, len(ids), 2000):
                counts = count_sentences(m, texts[a : a + 2000])
                d, k = np.nonzero(decide(counts))
                yield pd.DataFrame({"doc_id": ids[a : a + 2000][d], "subject": [m.subjects[i] for i in k.tolist()], "sentences": counts[d, k], "about_any": counts.sum(1)[d]})

    return documents.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, ABOUT)
