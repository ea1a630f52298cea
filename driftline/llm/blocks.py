"""Hashes of words, and blocks of numbers that chunks of documents and shards of a table send each other.

A chunk is some whole documents; a shard has a part of all that is counted. Rows that hold arrays as bytes pass between them, so
that what is done for each word is done in arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of texts whose words are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _RANDOM.integers(1, 2**63, 256, dtype=_U)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Two independent ways to hash runs of words.
STEPS = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))
LONG, BINARY = pa.int64(), pa.binary()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_POWER = _powers(_BASE, CHUNK + 1)
_UNPOWER = _powers(_INVERSE, CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hashed_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes."""
    power, unpower = (_POWER, _UNPOWER) if len(data) <= len(_POWER) else (_powers(_BASE, len(data)), _powers(_INVERSE, len(data)))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_LETTER[data] * power[: len(data)], dtype=_U)))
    return mix((sums[ends] - sums[starts]) * unpower[starts] + (ends - starts).astype(_U))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes that end with a blank."""
    edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True))  # word starts and ends take turns
    return edge[::2], edge[1::2]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts in a row, and for each text how many words it has. Vectorised over bytes."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends = word_spans(data)
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashed_spans(data, starts, ends), np.diff(np.searchsorted(starts, limits), prepend=0)


def rolled(hashes: np.ndarray, length: int, step: np.uint64) -> np.ndarray:
    """Hashes of all runs of so many words."""
    out = np.zeros(max(0, len(hashes) - length + 1), _U)
    for j in range(length):
        out = out * step + hashes[j : j + len(out)]
    return mix(out)


def chunks(texts: list[str | bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8 in groups of bounded size, each with the place of its first."""
    group, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b""
        if group and size + len(raw) + 1 >= CHUNK:
            yield first, group
            group, size, first = [], 0, i
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield first, group


def distinct_words(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different hash stands first, in the order of hashes, and for each place which of them stands there."""
    low = max(1, len(h) - 1).bit_length()  # all but the lowest bits tell words apart, hardly ever not
    distinct, which = grouped(h >> _U(low), 64 - low)
    first = _firsts(which, len(distinct))
    if (h[first][which] != h).any():
        distinct, which = np.unique(h, return_inverse=True)
        first = _firsts(which, len(distinct))
    return first, which


def _firsts(which: np.ndarray, n: int) -> np.ndarray:
    first = np.full(n, len(which))
    np.minimum.at(first, which, np.arange(len(which)))
    return first


@dataclass
class Texts:
    """Whole texts of a chunk: the batches without their text that they came with, how many words each has, and of all words in a row
    the hashes, the sizes and the letters."""

    batches: list[pa.RecordBatch]
    counts: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray
    letters: np.ndarray

    def column(self, name: str) -> pa.Array:
        return pa.concat_arrays([b.column(name) for b in self.batches])


def read_chunks(batches: Iterator[pa.RecordBatch], most: int, lower: bool = False) -> Iterator[Texts]:
    """Rows with a text as chunks of about so many words and texts; lower makes A-Z small."""
    held: list[tuple] = []
    n = 0
    for b in batches:
        for first, group in chunks(b.column("text").to_pylist()):
            joined = b" ".join(group)
            data = np.frombuffer((joined.lower() if lower else joined) + b" ", np.uint8)
            starts, ends = word_spans(data)
            counts = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in group])), prepend=0)
            runs = np.diff(np.concatenate(([0], np.stack([starts, ends], 1).reshape(-1), [len(data)])))
            letters = data[np.repeat(np.arange(len(runs)) % 2 == 1, runs)]
            held.append((b.slice(first, len(group)).drop_columns(["text"]), counts, hashed_spans(data, starts, ends), ends - starts, letters))
            n += len(starts) + len(group)
            if n >= most:
                n = 0
                yield _joined(held)
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> Texts:
    """The pieces of a chunk as one; the pieces go, so that memory doesn't hold both."""
    out = Texts([x[0] for x in held], *(np.concatenate([x[k] for x in held]) for k in range(1, 5)))
    held.clear()
    return out


def pack(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs: all lowest bytes first, so that the mostly empty higher ones
    stand together and compress well. The last byte says how many there are of each."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() + bytes([width])


def unpack(b: bytes) -> np.ndarray:
    width = b[-1]
    planes = np.frombuffer(b, np.uint8, len(b) - 1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").reshape(-1)


def grouped(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The different codes (below 2 ** bits), sorted, and for each place which of them stands there."""
    wide = max(1, len(code) - 1).bit_length()
    if bits + wide > 64:
        return np.unique(code, return_inverse=True)
    both = np.sort(code.astype(_U) << _U(wide) | np.arange(len(code), dtype=_U))  # one sort of plain numbers
    code, place = both >> _U(wide), (both & _U((1 << wide) - 1)).astype(np.int64)
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    which = np.empty(len(code), np.int64)
    which[place] = np.cumsum(new) - 1
    return code[new], which


def cut(data: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The bytes of some of the pieces of data, which have so many bytes each, in a row."""
    start, size = (np.cumsum(size) - size)[which], size[which]
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def shard_limits(h: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of sorted hashes ends; shards are equal ranges of the first 32 bits."""
    return np.searchsorted(((h >> _U(32)) * _U(shards)) >> _U(32), np.arange(shards + 1))


def batch_of(schema: list[tuple[str, pa.DataType]], found: list[tuple]) -> pa.RecordBatch:
    """A batch of a few rows, given column by column what they are."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not every C library has it
    _TRIM = None


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean_batches(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that releases its memory when its task is done. A worker that waits for the next one would else keep the most
    that it ever used."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return each


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Rows are blocks while this lasts: few to a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        yield
    finally:
        spark.conf.set(key, before)
