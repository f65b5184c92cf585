"""What the corpus operators share: word hashing, bounded Arrow batches, and the engine's shared-folder helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workledger.shared import shared_path as shared_dir
from workledger.shared import shared_root
from workledger.shared import skew_join, written

__all__ = ["shared_dir", "shared_root", "skew_join", "written"]

#: Rows of one Arrow batch handed to Python. Bounds a worker's memory when rows are long texts.
BATCH_ROWS = 256


def python_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that tasks hand to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; null is the empty text."""
    return F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (multiply and shift, wrapping)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width``-word window in order; fewer words give one shingle of all of them."""
    n = len(hashes)
    if not n:
        return hashes
    width_here = min(width, n)
    count = n - width_here + 1
    out = np.full(count, np.uint64(width_here))
    for i in range(width_here):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
    return out


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(words_of(text)), width))


def binary_lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    lengths = np.fromiter((len(v) for v in values), np.int32, len(values))
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df
