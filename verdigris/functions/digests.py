"""The beginnings of MD5 digests of many short texts at once, in arrays.

A text of up to 55 bytes is one block. Blocks of a few thousand texts are held
word by word as arrays, on which the steps of the digest are done for all of
them together; longer texts go one by one through ``hashlib``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

#: Texts that are worked on at once, enough that a step costs more than its call.
AT_ONCE = 32_768
#: Bytes that fit in one block beside the mark of the end and the length.
MOST = 55
_BLOCK = np.arange(64, dtype=np.uint8)
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [[(np.uint32(t), np.uint32(32 - t)) for t in turns] for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]
_WORD = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Steps until the digest's first word is known; the last three touch the others.
_STEPS = 61


def _first_words(words: np.ndarray) -> np.ndarray:
    """The digests' first words of blocks, which are columns of ``words`` (16, n)."""
    n = words.shape[1]
    some = [bool(w.any()) for w in words]
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(_STEPS):
        kind, word = i // 16, _WORD[i // 16](i)
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        np.add(a, _SINES[i], out=a)
        if some[word]:
            np.add(a, words[word], out=a)
        left, right = _TURNS[kind][i % 4]
        np.left_shift(a, left, out=g)
        np.right_shift(a, right, out=a)
        np.bitwise_or(a, g, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()  # b is the first word once the three steps have moved it on


def heads(stems: pa.Array, tails: tuple[bytes, ...] = (b"",)) -> list[np.ndarray]:
    """For each tail the first 32 bits of the MD5 digests of all stems with that tail, as their first eight hexadecimal digits say.

    Null stems count as empty ones.
    """
    stems = stems.cast(pa.large_binary()).fill_null(b"")
    begins = np.frombuffer(stems.buffers()[1], np.int64)[stems.offset : stems.offset + len(stems) + 1] if len(stems) else np.zeros(1, np.int64)
    data = stems.buffers()[2] if len(stems) else None
    raw = np.zeros(begins[-1] - begins[0] + 64, np.uint8)
    if data is not None:
        raw[:-64] = np.frombuffer(data, np.uint8)[begins[0] : begins[-1]]
    starts = begins[:-1] - begins[0]
    sizes = np.diff(begins)
    around = np.lib.stride_tricks.sliding_window_view(raw, 64)
    out = [np.empty(len(stems), np.uint32) for _ in tails]
    for at in range(0, len(stems), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        size = np.minimum(sizes[part], MOST)
        blocks = around[starts[part]] * (_BLOCK < size.astype(np.uint8)[:, None])
        place = np.arange(len(size))
        for head, tail in zip(out, tails, strict=True):
            whole, end = blocks.copy(), np.minimum(size + len(tail), MOST)
            for k, byte in enumerate(tail):
                whole[place, np.minimum(size + k, MOST)] = byte
            whole[place, end] = 0x80
            words = np.ascontiguousarray(whole.view("<u4").T)
            words[14] = end * 8
            head[part] = _first_words(words)
    for head, tail in zip(out, tails, strict=True):
        for k in np.flatnonzero(sizes + len(tail) > MOST).tolist():
            head[k] = int.from_bytes(hashlib.md5(raw[starts[k] : starts[k] + sizes[k]].tobytes() + tail).digest()[:4])
    return out


def below(share: float, heads_: np.ndarray) -> np.ndarray:
    """Which of ``heads`` name a number in [0, 1) below ``share``."""
    return heads_ < math.ceil(share * 2**32)
