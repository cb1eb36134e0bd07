"""Tier 0 on a live stream: the same ratio as in batch, channel by channel.

Chunks (arr, ch, i0, samples) come in order within a channel; the state of a
channel is its last sta + lta + gap samples, so it doesn't grow. As a live
recording's greatest value isn't known, the long-term floor is absolute. After
a gap a channel warms up anew; samples that come late have a null ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenarray.operators.triage import Tier0

CHUNK = "arr bigint, ch int, i0 int, samples array<bigint>"
RATIO = "arr bigint, ch int, i int, ratio double"


def ratios(samples: np.ndarray, held: np.ndarray, first: int, cfg: Tier0) -> np.ndarray:
    """Ratio of the new samples, given those before (fewer at the start)."""
    p = np.concatenate([np.zeros(cfg.warm - len(held)), held.astype(float), samples.astype(float)]) ** 2
    c = np.append(0, np.cumsum(p))
    k = np.arange(cfg.warm, cfg.warm + len(samples)) + 1
    delay = cfg.sta + cfg.gap
    short = (c[k] - c[k - cfg.sta]) / cfg.sta
    long = (c[k - delay] - c[np.maximum(k - delay - cfg.lta, 0)]) / cfg.lta
    return np.where(np.arange(first, first + len(samples)) < cfg.warm, 1.0, short / (long + 1e-12))


def sta_lta(chunks: DataFrame, cfg: Tier0 = Tier0()) -> DataFrame:
    """Streaming RATIO rows of streaming CHUNK rows."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, warm_from, held = state.get if state.exists else (0, 0, [])
        rows = pd.concat(list(batches)).sort_values("i0").drop_duplicates("i0")
        for i0, samples in zip(rows["i0"].tolist(), rows["samples"], strict=True):
            x = np.asarray(samples)
            late = max(0, min(first - i0, len(x)))
            if late:  # judged before, or passed over in a gap
                yield pd.DataFrame({"arr": key[0], "ch": key[1], "i": np.arange(i0, i0 + late), "ratio": None})
                i0, x = i0 + late, x[late:]
            if not len(x):
                continue
            if i0 > first:
                warm_from, held = i0, []
            before = np.asarray(held, dtype=np.int64)
            yield pd.DataFrame({"arr": key[0], "ch": key[1], "i": np.arange(i0, i0 + len(x)), "ratio": ratios(x, before, i0 - warm_from, cfg)})
            held, first = [int(v) for v in np.concatenate([before, x])[-cfg.warm :]], i0 + len(x)
        state.update((first, warm_from, held))

    return chunks.groupBy("arr", "ch").applyInPandasWithState(run, RATIO, "next int, warm_from int, held array<bigint>", "append", GroupStateTimeout.NoTimeout)
