"""What the corpus operators share: reading tables, stable keys, checkpoints and Arrow text buffers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch of texts.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, after the session's limit on the bytes of Arrow batches is lowered to BATCH_BYTES.

    Batches are else of so many rows, and texts may be long: a task would hold several times 64 MB.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", df.sparkSession.conf.get(name).strip().lower()).groups()
    most = int(number) << 10 * (" kmgt".index(unit) if unit else 0)
    if most <= 0 or most > BATCH_BYTES:
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df


class Shipped:
    """Arrays in a file that each executor fetches once and its workers map into memory, so that a model may be larger than a worker's share.

    The driver's file goes with the driver.
    """

    def __init__(self, spark: SparkSession, arrays: dict[str, np.ndarray]):
        folder = tempfile.mkdtemp(prefix="shipped-")
        atexit.register(shutil.rmtree, folder, True)
        self._layout: dict[str, tuple[str, int, tuple[int, ...]]] = {}
        self._file = f"arrays-{uuid.uuid4().hex}"
        with open(f"{folder}/{self._file}", "wb") as out:
            for name, array in arrays.items():
                self._layout[name] = (array.dtype.str, out.tell(), array.shape)
                out.write(np.ascontiguousarray(array).tobytes())
                out.write(bytes(-out.tell() % 16 or 16))  # a file has some bytes though all arrays are empty
        spark.sparkContext.addFile(f"{folder}/{self._file}")
        self._raw: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_raw": None}

    def __getitem__(self, name: str) -> np.ndarray:
        if self._raw is None:
            self._raw = np.memmap(SparkFiles.get(self._file), np.uint8, "r")
        dtype, at, shape = self._layout[name]
        return np.ndarray(shape, dtype, self._raw, at)


def crc32_of(column: Column) -> Column:
    """Unsigned CRC32 of the UTF-8 bytes of a column as text; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8"))


def stable_key(*columns: Column) -> Column:
    """A non-negative 60-bit number of the columns as text, the same in any engine that has MD5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n + 1 offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row is a range by itself."""
    cuts, first = [], 0
    n = len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        cuts.append((first, min(last, n)))
        first = cuts[-1][1]
    return cuts


class WordHasher:
    """Words of many texts at once, as arrays: begin and end bytes, row, and a 64-bit hash of each word.

    A word is a longest run of bytes for which `is_word` holds; `fold` maps each byte before hashing.
    The hash is a polynomial over random values of the bytes, modulo 2**64.
    """

    _BASE = np.uint64(0x9E3779B97F4A7C15)
    _INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

    def __init__(self, is_word: np.ndarray, fold: np.ndarray):
        values = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
        self.is_word, self.values = is_word.astype(np.uint8), values[fold]
        self._powers = self._back = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            with np.errstate(over="ignore"):
                ones = np.ones(n, np.uint64)
                ones[1:] = self._BASE
                self._powers = np.cumprod(ones)
                ones[1:] = self._INVERSE
                self._back = np.cumprod(ones)

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end byte of each word, and the number of words of each row."""
        word = self.is_word[data]
        before, after = np.zeros(len(word), np.uint8), np.zeros(len(word), np.uint8)
        before[1:], after[:-1] = word[:-1], word[1:]
        full = offsets[:-1][np.diff(offsets) > 0]
        before[full] = 0
        after[offsets[1:][np.diff(offsets) > 0] - 1] = 0
        begin = np.flatnonzero(word & (1 - before))
        end = np.flatnonzero(word & (1 - after)) + 1
        return begin, end, np.diff(np.searchsorted(begin, offsets))

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.values[data] * self._powers[: len(data)], out=total[1:])
            mixed = (total[end] - total[begin]) * self._back[begin]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            return mixed ^ (mixed >> np.uint64(32))


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the ranges, ends included."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Folds A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8) + np.where(byte_table((0x41, 0x5A)), 32, 0).astype(np.uint8)
#: Bytes of words that hold ASCII letters, digits and all that isn't ASCII.
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
