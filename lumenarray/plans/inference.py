"""Micro-batched model inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def micro_batched(traces: DataFrame, infer: Callable[[np.ndarray], list], most: int = 64) -> DataFrame:
    """arr, ch, result, error: `infer` called on stacks of at most `most` traces
    of one length. It must give one result for each; a batch that fails or
    gives another number fails its own rows only."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby(b["samples"].map(len)):
                for a in range(0, len(g), most):
                    part = g.iloc[a : a + most]
                    try:
                        got, error = list(infer(np.array(part["samples"].tolist(), float))), None
                        if len(got) != len(part):
                            raise ValueError(f"{len(got)} results for {len(part)} traces")
                    except Exception as e:  # noqa: BLE001 - reported with the rows
                        got, error = [None] * len(part), str(e)
                    yield pd.DataFrame({"arr": part["arr"], "ch": part["ch"], "result": [None if x is None else str(x) for x in got], "error": error})

    return traces.filter("samples is not null").select("arr", "ch", "samples").mapInPandas(run, "arr bigint, ch int, result string, error string")


def onnx(path: str, name: str = "input") -> Callable[[np.ndarray], list]:
    """An `infer` that takes the class of greatest logit; one session a worker."""
    held: list = []

    def infer(x: np.ndarray) -> list:
        if not held:
            import onnxruntime

            held.append(onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"]))
        return np.argmax(held[0].run(None, {name: x.astype(np.float32)})[0], axis=1).tolist()

    return infer
