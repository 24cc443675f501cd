"""Helpers shared by the corpus operators: Arrow text access and word hashing."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_BLOCK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that are written and no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the row offsets in them; null is the empty text."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(space: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a quarter of a megabyte or so that end at white space or a row's end, so that no word is cut."""
    at, n = 0, len(space)
    while at < n:
        end = at + _BLOCK
        while end < n:
            lo = max(at + 1, end - 4096)
            cuts = np.flatnonzero(space[lo:end] | first[lo:end])
            if len(cuts):
                end = lo + int(cuts[-1])
                break
            end += 4096
        end = min(end, n)
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()):
    """Blocks of the words of the rows: begins, ends and 64-bit hashes, and a row of hashes for each prefix length.

    Words are runs of bytes outside ``gap``, with A-Z in lower case; a word's hash
    depends on its bytes alone. The hash of a prefix is 0 in shorter words. Memory
    beyond the input is a few megabytes a block.
    """
    space = gap[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    for lo, hi in _blocks(space, first):
        word = ~space[lo:hi]
        begin = word.copy()
        begin[1:] &= ~word[:-1] | first[lo + 1 : hi]
        starts = np.flatnonzero(begin)
        if not len(starts):
            continue
        last = word.copy()
        last[:-1] &= ~word[1:] | first[lo + 1 : hi]
        ends = np.flatnonzero(last) + 1
        # A word's hash is a sum of one random number for each byte at its place in the word.
        at = np.arange(hi - lo)
        place = at - np.maximum.accumulate(np.where(begin, at, 0))
        sums = np.zeros(hi - lo + 1, _U)
        np.cumsum(mix(_LOWER[data[lo:hi]] + place.astype(_U) * _U(256) + _U(0x9E3779B97F4A7C15)), out=sums[1:])

        def value(to: np.ndarray) -> np.ndarray:
            return mix(sums[to] - sums[starts] + (to - starts).astype(_U) * _U(0xD6E8FEB86659FD93))

        parts = [np.where(ends - starts >= n, value(np.minimum(starts + n, ends)) ^ np.uint64(n), np.uint64(0)) for n in prefixes]
        yield starts + lo, ends + lo, value(ends), parts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words between ASCII white space, and the index of each row's first word."""
    blocks = [(starts, hashes) for starts, _, hashes, _ in words(data, offsets)]
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    places = np.concatenate([p for p, _ in blocks])
    return np.concatenate([h for _, h in blocks]), np.searchsorted(places, offsets).astype(np.int64)


def row_slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or a single row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)
