"""Batch text work in numpy, on the UTF-8 bytes that Arrow holds.

Everything here runs in steps of a bounded number of bytes, so that a batch of very long texts
costs no more memory than the words or sums it leaves behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

STEP = 1 << 19
GIANT_WORD = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, and a random value per byte."""
    n = STEP + GIANT_WORD + 16
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down), mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and each text's bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    offs = np.frombuffer(bounds, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of text; one row at least each."""
    if not batch.num_rows:
        return
    _, offs = text_bytes(batch.column(batch.schema.names.index(column)))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def words(data: np.ndarray, offs: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of texts: (row, 64-bit hash, length in bytes) in order.

    fold lower-cases A-Z first. A word's hash depends on its bytes alone.
    """
    up, down, value = _powers()
    rows, hashes, lengths = [], [], []
    total, at = len(data), 0
    while at < total:
        upto = min(total, at + STEP)
        if upto < total:
            upto = _cut(data, offs, at, upto)
        part = data[at:upto]
        gap = _SPACE[part]
        inside = ~gap
        first = inside.copy()
        first[1:] &= gap[:-1]
        lo, hi = np.searchsorted(offs, [at, upto])
        begins = offs[lo:hi] - at
        begins = begins[begins < len(part)]
        first[begins] |= inside[begins]
        starts = np.flatnonzero(first)
        if len(starts):
            last = inside.copy()
            last[:-1] &= gap[1:] | first[1:]
            ends = np.flatnonzero(last) + 1
            if fold:
                part = _FOLD[part]
            size = ends - starts
            small = size <= GIANT_WORD
            if len(part) <= len(up):
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(value[part] * up[: len(part)], out=sums[1:])
                h = (sums[ends] - sums[starts]) * down[starts]
            else:
                h = np.zeros(len(starts), np.uint64)
                small &= False
                for i in np.flatnonzero(size <= GIANT_WORD):
                    piece = part[starts[i] : ends[i]]
                    h[i] = (value[piece] * up[: len(piece)]).sum(dtype=np.uint64)
                    small[i] = True
            for i in np.flatnonzero(~small):
                h[i] = int.from_bytes(hashlib.blake2b(part[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
            rows.append((np.searchsorted(offs, starts + at, "right") - 1).astype(np.int32))
            hashes.append(mix64(h + size.astype(np.uint64) * _M2))
            lengths.append(size.astype(np.int32))
        at = upto
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(lengths)


def _cut(data: np.ndarray, offs: np.ndarray, at: int, upto: int) -> int:
    """The last place in (at, upto] where no word is cut; beyond upto if there is none before."""
    text = int(offs[np.searchsorted(offs, upto, "right") - 1])
    gaps = np.flatnonzero(_SPACE[data[max(at, upto - GIANT_WORD) : upto]])
    best = max(text, max(at, upto - GIANT_WORD) + int(gaps[-1]) + 1 if len(gaps) else 0)
    if best > at:
        return best
    while upto < len(data):
        gaps = np.flatnonzero(_SPACE[data[upto : upto + STEP]])
        nexts = offs[np.searchsorted(offs, upto)]
        found = min(int(nexts), upto + int(gaps[0]) if len(gaps) else len(data))
        if len(gaps) or nexts <= upto + STEP:
            return max(found, at + 1)
        upto += STEP
    return len(data)


def shingles(data: np.ndarray, offs: np.ndarray, width: int, bits: int = 47) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of word shingles: (row bounds, ascending hashes of `bits` bits).

    With fewer words than `width`, the whole sequence is the one shingle; without words the set is empty.
    """
    n = len(offs) - 1
    rows, h, _ = words(data, offs)
    bounds, values = np.zeros(n + 1, np.int64), []
    if not len(rows):
        return bounds, np.zeros(0, np.uint64)
    first = np.searchsorted(rows, np.arange(n + 1))
    count = np.diff(first)
    salts = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    for lo in range(0, n, 1 << 12):
        hi = min(n, lo + (1 << 12))
        a, b = first[lo], first[hi]
        if a == b:
            continue
        part, who = h[a:b], rows[a:b].astype(np.int64) - lo
        full = max(0, len(part) - width + 1)
        got = np.zeros(full, np.uint64)
        for k in range(width):
            got += part[k : k + full] * salts[k]
        keep = who[:full] == who[width - 1 :] if full else np.zeros(0, bool)
        got, own = got[keep], who[:full][keep]
        short = np.flatnonzero((count[lo:hi] > 0) & (count[lo:hi] < width))
        if len(short):
            whole = np.array([_whole(h[first[lo + i] : first[lo + i + 1]], salts) for i in short], np.uint64)
            got, own = np.concatenate([got, whole]), np.concatenate([own, short])
        key = mix64(got) >> np.uint64(64 - bits)
        key |= own.astype(np.uint64) << np.uint64(bits)
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        bounds[lo + 1 : hi + 1] += np.bincount((key >> np.uint64(bits)).astype(np.int64), minlength=hi - lo)
        values.append(key & np.uint64((1 << bits) - 1))
    return np.cumsum(bounds), np.concatenate(values) if values else np.zeros(0, np.uint64)


def _whole(h: np.ndarray, salts: np.ndarray) -> np.uint64:
    return np.uint64(int((h * salts[: len(h)]).sum(dtype=np.uint64)) + len(h) * int(_M1) & 0xFFFFFFFFFFFFFFFF)


@lru_cache(1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter; for those below 65536, its one-letter lower case."""
    letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x10000, dtype=np.uint32)
    for i in np.flatnonzero(letters[:0x10000]):
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return letters, lower


def code_points(data: np.ndarray, offs: np.ndarray, ahead: int, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Steps of (code points, how many of them start here, first row, row bounds).

    Yields (points, own, rows, bounds): points holds this step's characters and `ahead` more; the first
    `own[0]` belong to the step; rows are the texts met, and bounds where each begins and ends in points'
    numbering (ends may lie beyond the step, so that windows stay inside their text).
    """
    total, at = len(data), 0
    begins = (data & 0xC0) != 0x80
    while at < total:
        upto = min(total, at + step)
        while upto < total and not begins[upto]:
            upto += 1
        far = min(total, upto + 4 * ahead)
        while far < total and not begins[far]:
            far += 1
        points = np.frombuffer(data[at:far].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        own = int(begins[at:upto].sum())
        lo = int(np.searchsorted(offs, at, "right")) - 1
        hi = int(np.searchsorted(offs, upto, "left"))
        edge = np.clip(offs[lo : hi + 1], at, far) - at
        place = np.concatenate([[0], np.cumsum(begins[at:far])])[edge]
        yield points, np.array([own]), np.arange(lo, hi), place
        at = upto
