"""Golomb-Rice coding of sorted 64-bit numbers with numpy: all quotients in unary first, then all remainders."""

from __future__ import annotations

import struct

import numpy as np


def encode(numbers: np.ndarray) -> bytes:
    """``numbers``: sorted, unsigned 64-bit."""
    n = len(numbers)
    if not n:
        return b""
    gaps = np.diff(numbers, prepend=np.uint64(0)).astype(np.uint64)
    mean = int(numbers[-1]) // n
    width = min(63, max(0, mean.bit_length() - 1))
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    head = struct.pack("<IBI", n, width, len(unary))
    if not width:
        return head + np.packbits(unary).tobytes()
    bits = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - width :]
    return head + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def decode(code: bytes) -> np.ndarray:
    if not code:
        return np.empty(0, np.uint64)
    n, width, unary_bits = struct.unpack_from("<IBI", code)
    body = np.frombuffer(code, np.uint8, offset=9)
    cut = -(-unary_bits // 8)
    ends = np.flatnonzero(np.unpackbits(body[:cut], count=unary_bits))
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(width)
    if width:
        bits = np.zeros((n, 64), np.uint8)
        bits[:, 64 - width :] = np.unpackbits(body[cut:], count=n * width).reshape(n, width)
        gaps |= np.packbits(bits, axis=1).reshape(n, 8).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)
