"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factlake.session import work_path

# Texts are worked on in slices of about this many bytes, so that memory depends on
# one slice (or one longer text), not on the rows of an Arrow batch.
SLICE_BYTES = 1 << 20

HELD_OUT_FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the folder all executors share and read from there.

    Later steps start from the files, also after lost executors, and Spark knows their size.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(key: Column) -> Column:
    """True for the fold that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))


def sample_order(key: Column, seed: int) -> Column:
    """A seeded order of rows that does not depend on where they lie."""
    return F.xxhash64(F.lit(seed), key)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, start of each row and the end of all); nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    rows = len(texts)
    if not rows:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, starts, data = texts.buffers()
    starts = np.frombuffer(starts, dtype=kind)[texts.offset : texts.offset + rows + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, side="right")) - 1)
        last = min(last, rows)
        yield first, last, raw[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finisher of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 2), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def byte_values(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)


_VALUES = byte_values()


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from running sums: equal spans get equal values."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * _power_table("up", _BASE, n), out=sums[1:], dtype=np.uint64)
    down = _power_table("down", pow(_BASE, -1, 1 << 64), n + 1)
    length = (end - begin).astype(np.uint64)
    return mixed((sums[end] - sums[begin]) * down[begin] + length * np.uint64(0xD6E8FEB86659FD93))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of each run of bytes other than blanks; runs end where a row ends."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~_BLANK[data]
    fresh = np.ones(n + 1, dtype=bool)
    fresh[1:n] = _BLANK[data[:-1]]
    fresh[starts] = True
    begin = np.flatnonzero(inside & fresh[:n])
    closes = np.empty(n, dtype=bool)
    closes[:-1] = ~inside[1:]
    closes[-1] = True
    edge = starts[starts > 0] - 1
    closes[edge] = True
    end = np.flatnonzero(inside & closes) + 1
    return np.searchsorted(starts, begin, side="right") - 1, begin, end


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
