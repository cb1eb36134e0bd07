"""Problem 8: mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash; a document's virtual finish
time is the source's cumulative tokens up to it, divided by the source's
weight. All sources are merged in order of finish time and cut at the total
budget. Cumulative sums are taken within hash buckets and carried over from
bucket to bucket, so no task holds a whole source.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenarray.session import cut

VOCABULARY = os.environ.get("LUMENARRAY_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
BUCKET_ROWS = 20_000
# Fixed value: how texts are split before merging, as the vocabulary demands.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file, made once per worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(path: str = VOCABULARY):
    """Column function: tokens of whole texts; null for null."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts.tolist()], dtype="Int64")

    return count


def clean_source(name: Column) -> Column:
    """A source's name in its clean form: lower case, trimmed, underscores."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s\-]+", "_")


def running(df: DataFrame, keys: list[str], buckets: list[str], order: list[str], size: str, into: str) -> DataFrame:
    """Running sum of `size` by key in order of (buckets, order), inclusive.

    Summed within each bucket; the buckets' totals alone are summed up by key.
    """
    totals = df.groupBy(*keys, *buckets).agg(F.sum(size).alias("_t"))
    up = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *buckets, F.coalesce(F.sum("_t").over(up), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, *buckets).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_in", F.sum(size).over(within)).join(offsets, [*keys, *buckets]).withColumn(into, F.col("_before") + F.col("_in")).drop("_in", "_before")


def needed_copies(sources: list[tuple[str, int, int, float, int]], budget: int) -> list[tuple[str, int]]:
    """How many copies of each source the mixture can reach at most.

    sources: name, tokens, greatest document, weight, repeats. At virtual time
    v a source has at most min(weight * v, tokens * repeats) tokens in the
    mixture, and at least that less one document. So once these sums come to
    the budget and one document of each source, the budget has been passed.
    """
    goal = budget + sum(m for _, _, m, _, _ in sources)
    ends = sorted((a * r / w, w, a * r) for _, a, _, w, r in sources)
    full, rate, v = 0.0, sum(w for _, w, _ in ends), float("inf")
    for end, w, whole in ends:
        if full + rate * end >= goal:
            v = (goal - full) / rate
            break
        full, rate = full + whole, rate - w
    return [(s, r if v == float("inf") else min(r, math.ceil(w * v / a + 1e-6))) for s, a, _, w, r in sources]


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The mixture: doc_id, source, copy (from 1), tokens, finish, ends_at.

    The budget is the tokens of all documents. ends_at is the running total of
    the mixture, so that ordering by it gives the mixed sequence. Documents of
    sources without a target (or null), and those without tokens, are left
    out; a target without documents gives its share to the others, as does a
    source whose documents have all been used max_repeats times. Null texts
    have no tokens; targets with a null or no positive share are left out.
    """
    d = documents.filter("doc_id is not null").select("doc_id", clean_source(F.col("source")).alias("source"), F.coalesce(token_counts(vocabulary)("text"), F.lit(0)).alias("tokens"))
    counted = cut(d)
    budget, rows = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    t = targets.filter("source is not null and target_share > 0").groupBy(clean_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("weight"), F.max(F.greatest("max_repeats", F.lit(1))).alias("repeats"))
    used = counted.filter("tokens > 0").join(t, "source")
    # one row a target comes to the driver
    sources = [tuple(r) for r in used.groupBy("source").agg(F.sum("tokens"), F.max("tokens"), F.max("weight"), F.max("repeats")).collect()]
    reach = documents.sparkSession.createDataFrame(needed_copies(sources, budget), "source string, copies int")
    used = used.drop("repeats").join(reach, "source")
    n = max(1, -(-rows // bucket_rows))
    copies = used.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies").withColumn("_u", F.xxhash64("doc_id", "copy", F.lit(seed))).withColumn("_b", F.pmod("_u", F.lit(n)))
    queued = running(copies, ["source"], ["copy", "_b"], ["_u", "doc_id"], "tokens", "_c").withColumn("finish", F.col("_c") / F.col("weight"))
    # the fluid schedule ends at about `budget`; each finish bucket holds a like share
    wide = max(1.0, budget / n)
    merged = queued.select("doc_id", "source", "copy", "tokens", "finish", F.floor(F.col("finish") / wide).alias("_f"))
    # before the first bucket whose totals pass the budget everything is kept
    placed = running(merged, [], ["_f"], ["finish", "source", "copy", "doc_id"], "tokens", "ends_at")
    return placed.filter(F.col("ends_at") <= budget).drop("_f")


def shares(documents: DataFrame, targets: DataFrame, mixture: DataFrame) -> DataFrame:
    """Target and actual share of each target source in the mixture."""
    got = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max("copy").alias("most_copies"))
    t = targets.filter("source is not null").select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").distinct()
    joined = t.join(got, "source", "left").withColumn("_all", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # one row per target
    return joined.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (F.coalesce("tokens", F.lit(0)) / F.col("_all")).alias("actual_share"))
