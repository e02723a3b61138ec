"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Java's and Python's pattern of a word: a run of what is not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Maps A-Z to a-z and leaves every other byte as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(raw: bytes | None, fold: bool = False) -> list[bytes]:
    """The words of a UTF-8 text.  ``bytes.split`` parts at exactly 0x20 and 0x09-0x0D."""
    if raw is None:
        return []
    return (raw.translate(FOLD) if fold else raw).split()


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: An odd number: it has an inverse modulo 2**64.
_STEP = 0x9E3779B97F4A7C15
#: Bytes whose words are hashed at once.
_CHUNK = 1 << 20
_POWERS: list[np.ndarray] = []


def word_spans(buf: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end; ``outside`` tells which bytes part them."""
    edge = np.diff(np.r_[True, outside[buf], True].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS
    size = max(n, _CHUNK)
    made = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        row = np.full(size, base, np.uint64)
        row[0] = 1
        made.append(np.cumprod(row))
    if size == _CHUNK:
        _POWERS[:] = made
    return made


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, from sums over all bytes before."""
    out = np.empty(len(starts), np.uint64)
    cuts = np.r_[np.unique(np.searchsorted(starts, np.arange(0, len(buf), _CHUNK))), len(starts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        lo, hi = starts[a], ends[b - 1]
        power, inverse = _powers(hi - lo + 1)
        sums = np.r_[np.uint64(0), np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo])]
        s = starts[a:b] - lo
        out[a:b] = (sums[ends[a:b] - lo] - sums[s]) * inverse[s]
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Numbers one to one, with all bits depending on all."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each row of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own where it names none.

    The fallback is for local sessions only: there driver and executors are one process.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="keyloft-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`cut`, but as a Parquet table, which is smaller where rows are many and short."""
    at = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def pack_planes(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, the lowest first, without empty high planes.

    Small numbers of a wide type then take little room once Spark has compressed them.
    """
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    top = 8
    while top and not planes[top - 1].any():
        top -= 1
    return planes[:top].tobytes()


def unpack_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and data:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising uint64 numbers as planes of their differences."""
    return pack_planes(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack_planes(data, n), dtype=np.uint64)


def sort_order(keys: np.ndarray, bits: int = 64) -> np.ndarray:
    """Positions that sort uint64 keys of ``bits`` bits: radix passes over 16 bits each."""
    order = None
    for shift in range(0, bits, 16):
        digit = ((keys if order is None else keys[order]) >> np.uint64(shift)).astype(np.uint16)
        step = np.argsort(digit, kind="stable")
        order = step if order is None else order[step]
    return order


def sorted_unique(keys: np.ndarray) -> np.ndarray:
    """Distinct values in order; a sort beats the hash table of ``np.unique`` here."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def release_memory() -> None:
    """Give freed memory back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        return
