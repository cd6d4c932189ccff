"""Words and shingles of many texts at once, as numpy arrays over Arrow batches.

All functions take a whole Arrow batch and loop over no text, word or byte in Python.
Words are maximal runs of bytes other than space and 0x09-0x0D, so they never split a code point.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Also ASCII punctuation, for words without the marks around them.
MARKS = SPACES.copy()
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Fixed random codes of bytes; part of the definition of every hash below.
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_POWER = U64(0x9E3779B97F4A7C15)
_SHINGLE = U64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """Hashes of the lower-cased (A-Z) words of a batch of texts.

    ``hash`` and ``doc`` have one entry per word in order; ``first[i]:first[i+1]`` are the words of
    text ``i``; ``start`` is the place of the word in the bytes.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = True, breaks: np.ndarray = SPACES):
        n = len(offs) - 1
        word = ~breaks.take(data)
        begins = word.copy()
        if len(data):
            begins[1:] &= ~word[:-1]
            edge = offs[:-1][offs[:-1] < offs[1:]]
            begins[edge] = word[edge]
        self.start = np.flatnonzero(begins)
        self.doc = np.searchsorted(offs, self.start, side="right").astype(np.int64) - 1
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            self.length = np.zeros(0, np.int64)
            return
        codes = np.where(breaks, U64(0), _CODES[LOWER] if lower else _CODES)
        gap = np.diff(np.append(self.start, len(data)))
        place = np.arange(self.start[0], len(data), dtype=np.int32) - np.repeat(self.start.astype(np.int32), gap)
        powers = np.cumprod(np.append(U64(1), np.full(int(gap.max()), _POWER, np.uint64)))
        term = codes.take(data[self.start[0] :])
        term *= powers.take(place)
        self.hash = mix(np.add.reduceat(term, self.start - self.start[0]))
        stops = word.copy()
        stops[:-1] &= ~word[1:]
        last = offs[1:][offs[:-1] < offs[1:]] - 1
        stops[last] = word[last]
        self.length = np.flatnonzero(stops) + 1 - self.start


def shingles(words: Words, n_docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``size`` words, in order.

    A text with fewer words gives one shingle of all its words, a text without words none.
    """
    h, first = words.hash, words.first
    count = np.diff(first)
    out = []
    if len(h) >= size:
        acc = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            acc = acc * _SHINGLE + h[j : j + len(acc)]
        same = words.doc[: len(acc)] == words.doc[size - 1 :]
        out.append((mix(acc[same]), words.doc[: len(acc)][same]))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        acc = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            have = count[short] > j
            acc[have] = acc[have] * _SHINGLE + h[first[short[have]] + j]
        out.append((mix(acc + U64(1)), short))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(d, kind="stable")
    return h[order], d[order].astype(np.int64)


def per_text(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(hash, doc)`` with the count of each, sorted by doc; hashes are cut to 48 bits.

    A batch holds fewer than 65,536 texts, so one 64-bit sort orders both.
    """
    key = np.sort((doc.astype(np.uint64) << U64(48)) | (hashes >> U64(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key, count = key[at], np.diff(np.append(at, len(key)))
    return key & U64((1 << 48) - 1), (key >> U64(48)).astype(np.int64), count


def kept_columns(df, needed: dict[str, str]):
    """``needed`` maps our names to the caller's; rows of just these, so that other columns of any name can't clash."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in needed.items()])


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text has that remainder; a null id counts as an empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def planes(values: np.ndarray, width: int = 4) -> bytes:
    """Numbers of ``width`` bytes byte plane by byte plane, compressed, as most planes are nearly empty."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unplaned(raw: bytes, width: int = 4) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    flat = pa.Codec("zstd").decompress(raw[8:], n, asbytes=True) if n else b""
    out = np.zeros((n // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(flat, np.uint8).reshape(width, -1).T
    return out.view("<i8").ravel()


def batches_of(stream, rows: int, size: int):
    """Merge Arrow batches of a task up to ``rows`` rows or ``size`` bytes; splits larger ones."""
    held, n, b = [], 0, 0
    for batch in stream:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, min(256, rows, batch.num_rows - at))
            at += part.num_rows
            held.append(part)
            n += part.num_rows
            b += part.nbytes
            if n >= rows or b >= size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n, b = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    release_memory()


def release_memory() -> None:
    """Give freed memory back to the system, as a worker is kept for other tasks of its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library


