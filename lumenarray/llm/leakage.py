"""Problem 7: evaluation passages that leaked into training text.

Pigeonhole edit matching on words: a run of `run` words reproduced with at
most `errors` edits, cut into errors + 1 pieces, has one piece unharmed. For
each window of an item its own pieces are chosen, of any length, as rare as can
be. An exact hit of one names a candidate (document, item, diagonal); a count
of matching words, which no true case fails, and Myers' bit-parallel distance
verify each.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarray.llm.text import words

RUN, ERRORS = 30, 5
FORMULA_WORDS, FORMULA_ITEMS = 10, 3
LEAST_OWN = 15
LENGTHS = range(2, 11)
PART = 8192
BLOCK_CHARS = 32_000_000
FOUND = "doc_id bigint, item_id bigint, distance int, item_word int, doc_word int"


def myers(patterns: np.ndarray, lengths: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Myers' bit-parallel distance of many patterns at once.

    Row by row the least edit distance of patterns[:lengths] (63 words at
    most) to any stretch of the text, and where that stretch ends. Padding of
    patterns and texts must differ from each other and from all words.
    """
    n, m = patterns.shape
    bit = np.int64(1) << np.arange(m, dtype=np.int64)
    full = (np.int64(1) << lengths.astype(np.int64)) - 1
    high = np.int64(1) << (lengths.astype(np.int64) - 1)
    pv, mv = full.copy(), np.zeros(n, np.int64)
    score = lengths.astype(np.int64).copy()
    best, end = score.copy(), np.zeros(n, np.int64)
    for j in range(texts.shape[1]):
        eq = (patterns == texts[:, j : j + 1]) @ bit & full
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += ((ph & high) != 0).astype(np.int64) - ((mh & high) != 0)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        better = score < best
        best[better], end[better] = score[better], j
    return best, end


def own_words(patterns: np.ndarray, own: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Words of each pattern, of those that own marks, that an alignment of
    least distance to a stretch of the text matches (the most such)."""
    edit = 64
    step = edit * np.arange(texts.shape[1] + 1)
    d = np.zeros((len(patterns), texts.shape[1] + 1), np.int64)
    for i in range(patterns.shape[1]):
        lost = edit + own[:, i : i + 1].astype(np.int64)
        new = d + lost
        new[:, 1:] = np.minimum(new[:, 1:], d[:, :-1] + np.where(patterns[:, i : i + 1] == texts, 0, lost))
        new = np.minimum.accumulate(new - step, axis=1) + step
        d = np.where((patterns[:, i] == -2)[:, None], d, new)
    return own.sum(axis=1) - d.min(axis=1) % edit


@dataclass
class Items:
    """Pieces of a block of evaluation items, for look-up by hash: by length
    the hashes, a table of their last bits, where each one's places begin, and
    these (in `flat`, where the items lie end to end with gaps of 0)."""

    vocabulary: dict[str, int]
    ids: list[int]
    words: list[np.ndarray]
    formula: list[np.ndarray]
    flat: np.ndarray
    base: np.ndarray
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def piece_hashes(ids: np.ndarray, n: int, shorter: np.ndarray | None = None) -> np.ndarray:
    """Hash of each n-gram of word ids, from those of the (n-1)-grams if given;
    0 where a word is unknown (id 0)."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    if n == 1:
        return ids.astype(np.int64)
    h = piece_hashes(ids, n - 1) if shorter is None else shorter
    with np.errstate(over="ignore"):
        out = h[:-1] * np.int64(1_000_003) + ids[n - 1 :]
    out[(h[:-1] == 0) | (ids[n - 1 :] == 0)] = 0
    return out


def laid(seqs: list[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences end to end with gaps of 0 before, between and after them (two
    after the last); where each begins."""
    base = gap + np.append(0, np.cumsum([len(s) + gap for s in seqs])).astype(np.int64)
    flat = np.zeros(base[-1] + gap, np.int32)
    for s, b in zip(seqs, base.tolist(), strict=False):
        flat[b : b + len(s)] = s
    return flat, base[:-1]


def chosen(cost: np.ndarray, starts: np.ndarray, size: int, pieces: np.ndarray) -> np.ndarray:
    """Pieces (place, length) that windows take: of each window (starts, all of
    `size` words) as many disjoint ones as `pieces` says, cheapest in sum.
    cost: by length in LENGTHS and place, infinite where there is no piece."""
    most = int(pieces.max())
    f = np.full((size + 1, most + 1, len(starts)), np.inf, np.float32)
    f[:, 0] = 0
    step = np.zeros((size + 1, most + 1, len(starts)), np.int8)
    for p in range(1, size + 1):
        f[p, 1:] = f[p - 1, 1:]
        for k, n in enumerate(LENGTHS):
            if n <= p:
                x = f[p - n, :-1] + cost[k, starts + p - n]
                better = x < f[p, 1:]
                np.copyto(f[p, 1:], x, where=better)
                step[p, 1:][better] = n
    row, p, left, out = np.arange(len(starts)), np.full(len(starts), size), pieces.copy(), []
    while len(row):
        n = step[p, left, row].astype(np.int64)
        took = n > 0
        out.append(np.stack([(starts[row] + p - n)[took], n[took]], axis=1))
        p, left = p - np.maximum(n, 1), left - took
        row, p, left = (x[left > 0] for x in (row, p, left))
    return np.unique(np.concatenate(out), axis=0)


def grams(text: str) -> tuple[bytes, set[bytes]]:
    """Digests of a text's words and of its runs of FORMULA_WORDS words."""
    w = words(text)
    digest = lambda x: hashlib.blake2b(" ".join(x).encode(), digest_size=8).digest()
    return digest(w), {digest(w[k : k + FORMULA_WORDS]) for k in range(len(w) - FORMULA_WORDS + 1)}


def standing(eval_items: DataFrame) -> set[bytes]:
    """Digests of the formulas of all items: runs of FORMULA_WORDS words in
    FORMULA_ITEMS items of different text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(t, g) for t, found in map(grams, batch["text"].tolist()) for g in found], columns=["text", "gram"])

    found = eval_items.filter("item_id is not null and text is not null").select("text").mapInPandas(scan, "text binary, gram binary").distinct()
    return {bytes(r.gram) for r in found.groupBy("gram").count().filter(F.col("count") >= FORMULA_ITEMS).select("gram").collect()}


def prepare(rows: list[tuple[int, str]], run: int = RUN, errors: int = ERRORS, formulas: set[bytes] | None = None) -> Items:
    """Index of (item_id, text) rows. Standing formulas (runs of FORMULA_WORDS
    words in FORMULA_ITEMS items of different text, counted over these rows if
    not given) are marked and no anchors. A window that must match LEAST_OWN
    of its other words has room for fewer edits in them, and needs one piece
    more than these. Items
    without words are left out; equal texts share their hits."""
    vocabulary: dict[str, int] = {}
    ids, seqs, texts = [], [], []
    for i, text in rows:
        w = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in words(text)]
        if i is not None and w:
            ids.append(i)
            seqs.append(np.array(w, np.int64))
            texts.append(text)
    if formulas is None:
        spread = Counter(g for found in dict(map(grams, texts)).values() for g in found)
        formulas = {g for g, n in spread.items() if n >= FORMULA_ITEMS}
    marks = []
    for s, text in zip(seqs, texts, strict=True):
        formula = np.zeros(len(s), bool)
        w = words(text)
        for k in range(len(s) - FORMULA_WORDS + 1) if formulas else ():
            if hashlib.blake2b(" ".join(w[k : k + FORMULA_WORDS]).encode(), digest_size=8).digest() in formulas:
                formula[k : k + FORMULA_WORDS] = True
        marks.append(formula)
    flat, base = laid(seqs, run)
    own = np.zeros(len(flat), bool)
    for b, m in zip(base.tolist(), marks, strict=True):
        own[b : b + len(m)] = ~m
    out = Items(vocabulary, ids, seqs, marks, flat, base)
    if not seqs:
        return out
    first = {s.tobytes(): k for k, s in reversed(list(enumerate(seqs)))}
    once = np.zeros(len(flat), bool)  # equal texts count once
    for k in first.values():
        once[base[k] : base[k] + len(seqs[k])] = True
    free, h = np.where(own, flat, 0).astype(np.int64), None
    cost = np.full((len(LENGTHS), len(flat)), np.inf, np.float32)
    hashes = {}
    for n in range(1, LENGTHS[-1] + 1):
        h = piece_hashes(free, n, h)
        if n in LENGTHS and len(h):
            hashes[n] = h
            at = np.flatnonzero(h)
            _, which = np.unique(h[at], return_inverse=True)
            count = np.bincount(which, weights=once[at])[which] if len(at) else np.zeros(0)
            cost[n - LENGTHS[0], at] = count**2 + 64 * 4.0 ** (1 - n) + (h[at] >> 20 & 1023) / 4096
    total = np.append(0, np.cumsum(own))
    taken = []
    lengths = np.array([len(s) for s in seqs])
    for size in np.unique(np.minimum(lengths, run)).tolist():
        budget = errors * size // run
        if size < FORMULA_WORDS:  # a short quotation, if anything
            continue
        starts = np.concatenate([base[k] + np.arange(lengths[k] - size + 1) for k in np.flatnonzero(np.minimum(lengths, run) == size)])
        mine = total[starts + size] - total[starts]
        spare = np.where(mine == size, budget, np.minimum(budget, mine - LEAST_OWN))
        starts, spare = starts[spare >= 0], spare[spare >= 0]
        taken += [chosen(cost, starts[a : a + PART], size, spare[a : a + PART] + 1) for a in range(0, len(starts), PART)]
    taken = np.unique(np.concatenate(taken), axis=0) if taken else np.zeros((0, 2), np.int64)
    for n in LENGTHS:
        at = taken[taken[:, 1] == n, 0]
        if len(at):
            at = at[np.argsort(hashes[n][at], kind="stable")]
            known, begin = np.unique(hashes[n][at], return_index=True)
            bits = np.zeros(1 << max(16, int(len(known)).bit_length() + 4), bool)
            bits[known & (len(bits) - 1)] = True
            out.pieces[n] = known, bits, np.append(begin, len(at)), at
    return out


def candidates(ids: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact hits of pieces in a batch of documents, laid end to end: place in
    the items, place in the batch, length."""
    at, place, length, h = [], [], [], None
    for n in range(1, max(items.pieces, default=0) + 1):
        h = piece_hashes(ids, n, h)
        if n not in items.pieces or not len(h):
            continue
        known, bits, first, places = items.pieces[n]
        hit = np.flatnonzero(bits[h & (len(bits) - 1)])
        g = np.minimum(np.searchsorted(known, h[hit]), len(known) - 1)
        same = known[g] == h[hit]
        hit, g = hit[same], g[same]
        counts = first[g + 1] - first[g]
        at.append(places[np.repeat(first[g] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())])
        place.append(np.repeat(hit, counts))
        length.append(np.full(len(place[-1]), n))
    none = np.zeros(0, np.int64)
    return (np.concatenate(at), np.concatenate(place), np.concatenate(length)) if at else (none, none, none)


def short(ids: np.ndarray) -> np.ndarray:
    """One byte of each word's number, 0 for none: enough to rule windows out."""
    return np.where(ids > 0, (ids * 40_503 >> 4) % 255 + 1, 0).astype(np.uint8)


def windows(ids: np.ndarray, items: np.ndarray, at: np.ndarray, place: np.ndarray, size: int, errors: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `size` words around hits, from low to high: hit and start in
    the items of each in which at most `errors` words are missing from the
    neighbouring diagonals, as in any window within that distance. ids and
    items: the texts' and the items' words by their `short` bytes, whose gaps
    are wider than any window reaches."""
    rows = np.lib.stride_tricks.sliding_window_view
    mine = rows(items, 2 * size)[at - size]
    text = rows(ids, 2 * size + 2 * errors)[place - size - errors]
    there = np.zeros(mine.shape, bool)
    for s in range(2 * errors + 1):
        there |= mine == text[:, s : s + 2 * size]
    there &= mine > 0
    total = np.zeros((len(at), 2 * size + 1), np.uint8)
    np.cumsum(there, axis=1, out=total[:, 1:], dtype=np.uint8)
    hit, start = np.nonzero(total[:, size:] - total[:, : size + 1] >= size - errors)
    start = at[hit] - size + start
    fits = (start >= low[hit]) & (start <= high[hit])
    return hit[fits], start[fits]


def leaks(docs: list[np.ndarray], items: Items, run: int = RUN, errors: int = ERRORS) -> list[tuple[int, int, int, int, int]]:
    """(document, item, distance, item word, document word) of a batch; the
    budget of a shorter item is in proportion. Of a window with words of
    standing formulas, LEAST_OWN others must be matched, in one stretch or more."""
    ids, base = laid(docs, run + 2 * errors)
    at, place, length = candidates(ids, items)
    text_bytes, item_bytes = short(ids), short(items.flat)
    item = np.searchsorted(items.base, at, side="right") - 1
    sizes = np.array([len(s) for s in items.words], np.int64)
    best: list[np.ndarray] = []
    for size in np.unique(np.minimum(sizes[item], run)).tolist():
        budget = errors * size // run
        mine = np.flatnonzero(np.minimum(sizes[item], run) == size)
        found = []
        for a in range(0, len(mine), PART):
            x = mine[a : a + PART]
            low = np.maximum(items.base[item[x]], at[x] + length[x] - size)
            high = np.minimum(items.base[item[x]] + sizes[item[x]] - size, at[x])
            hit, start = windows(text_bytes, item_bytes, at[x], place[x], size, budget, low, high)
            found.append(start << 32 | start + (place[x] - at[x])[hit])  # one number, quick to sort
        todo = np.unique(np.concatenate(found))
        for a in range(0, len(todo), PART):
            start, text = todo[a : a + PART] >> 32, (todo[a : a + PART] & 0xFFFFFFFF) - budget
            k = np.searchsorted(items.base, start, side="right") - 1
            patterns = items.flat[start[:, None] + np.arange(size)].astype(np.int64)
            texts = ids[np.clip(text[:, None] + np.arange(size + 2 * budget), 0, len(ids) - 1)].astype(np.int64)
            distance, end = myers(patterns, np.full(len(start), size), texts)
            own = np.stack([~items.formula[i][b : b + size] for i, b in zip(k.tolist(), (start - items.base[k]).tolist(), strict=True)]) if len(k) else np.zeros((0, size), bool)
            near = distance <= budget
            enough = near & own.all(axis=1)
            check = np.flatnonzero(near & ~enough & (own.sum(axis=1) >= LEAST_OWN))
            enough[check] = own_words(patterns[check], own[check], texts[check]) >= LEAST_OWN
            r = np.flatnonzero(enough)
            word = text[r] + end[r]
            d = np.searchsorted(base, word, side="right") - 1
            best.append(np.stack([d, k[r], distance[r], start[r] - items.base[k[r]], word - base[d]], axis=1))
    if not best:
        return []
    rows = np.concatenate(best)
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return [tuple(x) for x in rows[first].tolist()]


def find(documents: DataFrame, eval_items: DataFrame, run: int = RUN, errors: int = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents (doc_id, text) with the items (item_id, text) leaked into them.

    Items are taken in blocks of at most about block_chars letters, each sent
    to the tasks as one index; documents are never shuffled. Null and empty
    texts and null ids give no row; a document posted twice gives a row for
    each doc_id; an item under FORMULA_WORDS words gives none, one under `run`
    words must come whole, its edits in proportion. What FORMULA_ITEMS items
    share word for word is a formula, however long. Output (FOUND): the best verified stretch of each pair.
    """
    chars = eval_items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    formulas = standing(eval_items) if blocks > 1 else None
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    out = None
    for b in range(blocks):
        block = eval_items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else eval_items
        index = documents.sparkSession.sparkContext.broadcast(prepare([tuple(r) for r in block.select("item_id", "text").distinct().orderBy("item_id").collect()], run, errors, formulas))

        def scan(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            items = index.value
            get = items.vocabulary.get
            for batch in batches:
                ids = batch["doc_id"].tolist()
                seqs = [np.fromiter(map(get, words(t), repeat(0)), np.int64) for t in batch["text"].tolist()]
                rows = [(ids[n], items.ids[k], d, i, j) for n, k, d, i, j in leaks(seqs, items, run, errors)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "item_word", "doc_word"])

        part = docs.mapInPandas(scan, FOUND)
        out = part if out is None else out.unionByName(part)
    return out.distinct()
