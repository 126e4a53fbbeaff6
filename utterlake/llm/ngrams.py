"""Hashed byte n-gram counts of Arrow string columns, in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GRAMS = (1, 2, 3, 4)
#: Bytes and rows that are counted together.
PIECE, ROWS = 1 << 20, 512


def _fold() -> np.ndarray:
    """Bytes to features: ASCII letters in lower case, other ASCII as a space, the rest as it is."""
    table = np.full(256, 32, np.uint8)
    for b in range(256):
        if chr(b).isalpha() and b < 128:
            table[b] = ord(chr(b).lower())
        elif b >= 128:
            table[b] = b
    return table


FOLD = _fold()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type):
        column = column.fill_null(b"").cast(pa.large_binary())
    else:
        column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def _pieces(at: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
    """Lists of (row, first byte, end of starts, end of bytes) of about PIECE bytes and at most ROWS parts; long rows come in parts that overlap by three bytes."""
    todo, size = [], 0
    for row, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for a in range(lo, max(hi, lo + 1), PIECE):
            b = min(a + PIECE, hi)
            todo.append((row, a, b, min(b + max(GRAMS) - 1, hi)))
            size += b - a
            if size >= PIECE or len(todo) >= ROWS:
                yield todo
                todo, size = [], 0
    if todo:
        yield todo


def counts(column: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, dense counts) of consecutive rows; every n-gram of every row counts once."""
    data, at = string_buffers(column)
    width, top, carry = 1 << bits, max(GRAMS), None
    for todo in _pieces(at):
        first = todo[0][0]
        rows = todo[-1][0] - first + 1
        parts, owner, starts = [], [], []
        for row, a, b, end in todo:
            parts += [data[a:end], np.zeros(top, np.uint8)]
            owner.append(row - first)
            starts.append((b - a, end - a + top))
        raw = np.concatenate(parts)
        pad = raw == 0
        buf = FOLD[raw]
        accent = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        buf[accent] += 32
        buf[pad] = 0
        which = np.repeat(np.array(owner, np.int64), [n for _, n in starts])
        inside = np.concatenate([np.arange(n) < s for s, n in starts])
        out = np.zeros(rows * width, np.int64)
        code = np.zeros(len(buf), np.uint32)
        for n in range(1, top + 1):
            m = len(buf) - n + 1
            if m <= 0:
                break
            code = code[:m] * np.uint32(257) + buf[n - 1 :]
            if n not in GRAMS:
                continue
            ok = inside[:m] & (buf[n - 1 :] != 0)
            slot = ((code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
            out += np.bincount(which[:m][ok] * width + slot[ok], minlength=len(out))
        out = out.reshape(rows, width).astype(np.float32)
        if carry is not None:
            if carry[0] == first:
                out[0] += carry[1]
            else:
                yield carry[0], carry[1][None]
        carry = (first + rows - 1, out[-1])
        if rows > 1:
            yield first, out[:-1]
    if carry is not None:
        yield carry[0], carry[1][None]
