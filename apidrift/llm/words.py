"""Words of whole texts as Arrow columns, cut by a table of byte kinds, and checksums of word sequences.

All separators of the operators that use this are ASCII, so texts can be cut on their UTF-8 bytes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GAP, BREAK = 0x20, 0x0A


def byte_table(gaps: bytes, breaks: bytes = b"") -> bytes:
    """A translation that lower-cases A-Z and makes ``gaps`` and ``breaks`` the two separators."""
    table = bytearray(range(256))
    table[0x41:0x5B] = range(0x61, 0x7B)
    for byte in gaps:
        table[byte] = GAP
    for byte in breaks:
        table[byte] = BREAK
    return bytes(table)


@dataclass
class Words:
    """All words of some texts in order."""

    words: pa.Array
    #: Words of each text.
    counts: np.ndarray
    #: Text of each word.
    text: np.ndarray
    #: Whether a word follows the one before in the same text, with no break between.
    linked: np.ndarray


def cut(texts: pa.Array, table: bytes) -> Words:
    """Runs of bytes that ``table`` makes no separator (null texts: none)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = bytes(memoryview(raw)[ends[0] : ends[-1]]).translate(table) if raw is not None else b""
    ends = ends - ends[0]
    marked = np.frombuffer(data, np.uint8)
    inside = (marked != GAP) & (marked != BREAK)
    edge = np.zeros(len(marked) + 1, bool)
    edge[ends] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    lengths = np.flatnonzero(inside & (~after | edge[1:])) - starts + 1
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(marked[inside])])
    counts = np.diff(np.searchsorted(starts, ends))
    text = np.repeat(np.arange(len(counts)), counts)
    piece = np.cumsum(marked == BREAK)[starts] if len(starts) else starts
    linked = np.zeros(len(starts), bool)
    linked[1:] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    return Words(words, counts, text, linked)


def longer(linked: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places one word on, where that word follows directly, and the values of the places before."""
    goes_on = np.append(linked, False)[at + 1]
    return at[goes_on] + 1, value[goes_on]


@lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """What ``length`` more bytes do to a crc32: its four bytes' parts of a linear map."""
    zeros = bytes(length)
    plain = zlib.crc32(zeros)
    parts = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        byte, low = divmod(bit, 8)
        parts[byte, (np.arange(256) >> low & 1) == 1] ^= np.uint32(zlib.crc32(zeros, 1 << bit) ^ plain)
    return parts


class Checksums:
    """crc32 of runs of words joined by one space, from those of the distinct words alone."""

    def __init__(self, distinct: pa.Array, codes: np.ndarray):
        spelled = distinct.cast(pa.large_binary()).to_pylist()
        lengths, kind = np.unique(np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1, return_inverse=True)
        self.first = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(spelled))[codes]
        self.next = np.fromiter((zlib.crc32(b" " + x) for x in spelled), np.uint32, len(spelled))[codes]
        self.shifts = np.concatenate([_shift(int(n)).ravel() for n in lengths]) if len(lengths) else np.zeros(0, np.uint32)
        self.base = (kind.astype(np.int64) << 10)[codes]

    def extended(self, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """crc32 of texts with checksum ``before`` and then a space and the word at each place ``at``."""
        result, base = self.next[at], self.base[at]
        for byte in range(4):
            result = result ^ self.shifts[base + (byte << 8) + (before >> np.uint32(8 * byte) & np.uint32(255))]
        return result
