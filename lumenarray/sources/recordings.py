"""Recording files to trace rows (S1, S2, S4-S9, S16), and result sinks (K1-K3).

Files are listed by Spark's binary source and decoded where they lie; rows:
file, ch, fs, dx, samples, attrs. A file travels as one binary value, so it may
have 2 GB at most. HDF5 needs h5py, which is asked for only when such a file is
read.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "file string, ch int, fs double, dx double, samples array<float>, attrs map<string,string>, error string"
PART = "file string, dataset string, shape array<int>, dtype string, attrs map<string,string>, error string"


def segy(data: bytes) -> tuple[np.ndarray, float]:
    """Channel matrix and sampling rate of a SEG-Y file in format 5 (IEEE floats):
    a 3600-byte header and traces with 240 bytes of header each."""
    interval, samples, kind = (int.from_bytes(data[3200 + k : 3202 + k], "big", signed=True) for k in (16, 20, 24))
    if kind != 5 or interval <= 0 or samples <= 0:
        raise ValueError("only format 5 with positive interval and length")
    size = 240 + 4 * samples
    if (len(data) - 3600) % size:
        raise ValueError("the size doesn't fit whole traces")
    rows = np.frombuffer(data, np.uint8, offset=3600).reshape(-1, size)[:, 240:]
    return rows.copy().view(">f4").astype(np.float32), 1e6 / interval


def npz(data: bytes, key: str = "data") -> np.ndarray:
    m = np.load(io.BytesIO(data))[key]
    if m.ndim != 2:
        raise ValueError("the matrix must have two dimensions")
    return m


def text(value: object) -> str:
    """An attribute as text; bytes are read as UTF-8, broken ones replaced."""
    return value.decode("utf-8", errors="replace") if isinstance(value, bytes) else str(value)


def hdf5(data: bytes, key: str = "data") -> tuple[np.ndarray, float, float, dict[str, str]]:
    """Matrix (of `key`, else the first with two dimensions), sampling rate,
    channel spacing and attributes of the matrix; needs h5py."""
    import h5py

    with h5py.File(io.BytesIO(data)) as f:
        found = f[key] if key in f else next(f[k] for k in f if getattr(f[k], "ndim", 0) == 2)
        attrs = {k: text(v) for k, v in found.attrs.items()}
        if "dt_s" not in attrs and "dt_s" in f.attrs:
            attrs["dt_s"] = text(f.attrs["dt_s"])
        return found[()], 1 / float(attrs.get("dt_s", 0.01)), float(attrs.get("dx_m", 8.0)), attrs


def _decoded(kind: str, key: str, fs: float, dx: float) -> Callable[[bytes], tuple[np.ndarray, float, float, dict[str, str]]]:
    if kind == "segy":
        return lambda b: (*segy(b), dx, {})
    if kind == "npz":
        return lambda b: (npz(b, key), fs, dx, {})
    return lambda b: hdf5(b, key)


def read(spark: SparkSession, path: str, kind: str, key: str = "data", fs: float = 100.0, dx: float = 8.0) -> DataFrame:
    """Trace rows of all files below `path` (a glob) of kind segy, npz or hdf5.
    A file that can't be decoded gives one row with its error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = _decoded(kind, key, fs, dx)
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                name = path.rpartition("/")[2]
                try:
                    m, rate, space, attrs = decode(content)
                    yield pd.DataFrame({"file": name, "ch": np.arange(len(m)), "fs": rate, "dx": space, "samples": list(m.astype(np.float32)), "attrs": [attrs] * len(m), "error": None})
                except Exception as e:  # noqa: BLE001 - reported as a row
                    yield pd.DataFrame({"file": [name], "ch": [None], "fs": [None], "dx": [None], "samples": [None], "attrs": [None], "error": [str(e)]})

    return files.mapInPandas(run, TRACE)


def _contents(kind: str, data: bytes) -> list[tuple[str, list[int], str, dict[str, str]]]:
    """Datasets of a file: name, shape, type, attributes; '/' has those of the file."""
    if kind == "npz":
        with np.load(io.BytesIO(data)) as f:
            return [(k, list(f[k].shape), str(f[k].dtype), {}) for k in f.files]
    if kind == "segy":
        m, rate = segy(data)
        return [("traces", list(m.shape), "float32", {"fs": text(rate)})]
    import h5py

    out = []
    with h5py.File(io.BytesIO(data)) as f:
        out.append(("/", [], "", {k: text(v) for k, v in f.attrs.items()}))
        f.visititems(lambda name, x: out.append((name, list(x.shape), str(x.dtype), {k: text(v) for k, v in x.attrs.items()})) if isinstance(x, h5py.Dataset) else None)
    return out


def inspected(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """What the files below `path` hold (PART): one row a dataset; a file that
    can't be read gives one row with its error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                name = path.rpartition("/")[2]
                try:
                    rows += [(name, *part, None) for part in _contents(kind, content)]
                except Exception as e:  # noqa: BLE001 - reported as a row
                    rows.append((name, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "dataset", "shape", "dtype", "attrs", "error"])

    return files.mapInPandas(run, PART)


def attribute(attrs: Column, name: str, default: str | None = None) -> Column:
    """An attribute of a file, the default where it has none."""
    return F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(default))


def catalogued(rows: DataFrame) -> DataFrame:
    """file, magnitude, event_time_index, event_time, latitude, longitude: what
    the files' attributes (file, attrs) say of the event, as `ground_truth` takes it."""
    num = lambda name, kind: attribute(F.col("attrs"), name).try_cast(kind).alias(name)
    return rows.filter("attrs is not null").dropDuplicates(["file"]).select("file", num("magnitude", "double"), num("event_time_index", "int"), attribute(F.col("attrs"), "event_time").alias("event_time"), num("latitude", "double"), num("longitude", "double"))


def event_index(index: Column, time: Column) -> Column:
    """A recording's event sample: null if missing, negative or without a time."""
    return F.when((index >= 0) & (time != ""), index)


def ground_truth(attrs: DataFrame) -> DataFrame:
    """file, truth: null where magnitude and a valid index are both missing."""
    valid = F.col("magnitude").isNotNull() | event_index(F.col("event_time_index"), F.col("event_time")).isNotNull()
    return attrs.select("file", F.when(valid, F.struct("magnitude", F.nullif("event_time", F.lit("")).alias("origin_time"), "latitude", "longitude")).alias("truth"))


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """Verdicts, matrices or summaries as JSON lines or Parquet."""
    df.write.mode("overwrite").format(kind).save(path)
