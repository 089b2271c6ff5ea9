"""Whole texts as byte arrays: batches, words and hashes without a Python object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Hands freed memory back to the system, so that idle workers don't keep it; absent outside glibc.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
STEP = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
#: Bytes of tokens [^\x20\x09-\x0D]+.
IS_TOKEN = np.ones(256, dtype=bool)
IS_TOKEN[[9, 10, 11, 12, 13, 32]] = False


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, STEP), base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have[: n + 1]


def power_at(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents, modulo 2 ** 64, from a table of STEP powers and one of powers of the STEP-th."""
    low = powers(base, STEP - 1)[exponents & (STEP - 1)]
    most = int(exponents.max(initial=0)) // STEP
    return low * powers(pow(base, STEP, 1 << 64), most)[exponents // STEP] if most else low


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ U64(seed)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def prefix_hashes(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """sums[i] = sum over j < i of (data[j] + 1) * base ** j."""
    sums = np.zeros(len(data) + 1, dtype=U64)
    ahead = U64(1)
    for k in range(0, len(data), STEP):  # a part at a time, so that a long text takes eight bytes a byte
        part = data[k : k + STEP].astype(U64)
        part += U64(1)
        part *= powers(base, STEP - 1)[: len(part)]
        part *= ahead
        np.cumsum(part, out=sums[k + 1 : k + 1 + len(part)])
        sums[k + 1 : k + 1 + len(part)] += sums[k]
        with np.errstate(over="ignore"):
            ahead *= U64(pow(base, STEP, 1 << 64))
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: int = BASE_INVERSE) -> np.ndarray:
    """Polynomial hashes of data[start:end], alike wherever the bytes stand."""
    return (sums[ends] - sums[starts]) * power_at(inverse, starts)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's bounds in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary()) if not pa.types.is_null(column.type) else pa.array([b""] * len(column), pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes of text each (a longer text stands alone), with bytes and bounds."""
    if not batch.num_rows:
        return
    data, bounds = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1)
        yield batch.slice(first, last - first), data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last
    _trim(0)


class Words:
    """The words of a run of texts: byte bounds, 64-bit hashes, and each text's range of words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind: np.ndarray = IS_WORD, hashed: bool = True):
        self.low = LOWER[data]
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = kind[data]
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside[:-1]
        cut = bounds[bounds < len(data)]
        after = inside.copy()
        after[cut] = False
        before[cut] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside[:-1] & ~after[1:]) + 1
        self.bounds = np.searchsorted(self.starts, bounds)
        if hashed:
            self.hashes = mix(range_hashes(prefix_hashes(self.low), self.starts, self.ends))

    def __len__(self) -> int:
        return len(self.starts)

    def of_doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes that Words gives to these words."""
    if not words:
        return np.zeros(0, dtype=U64)
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    return mix(range_hashes(prefix_hashes(data), starts, ends))


def find(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.searchsorted(sorted_keys, values)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == values, at, -1)


def result(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in ((f.name, columns[f.name]) for f in schema)], schema=schema)
