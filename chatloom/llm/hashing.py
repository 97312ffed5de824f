"""Vectorised word hashing over Arrow batches of whole texts.

A slice of a batch is one byte buffer with the texts end to end; a word's hash is a difference of
polynomial prefix sums, so no Python code runs per character or per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GROW = 1 << 20
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: A-Z to a-z, byte by byte; bytes of other UTF-8 characters stay.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes that end a word when words are `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that one call works on, unless a single text is longer.
SLICE_BYTES = 1 << 20


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        factor = np.full(-(-n // _GROW) * _GROW, _BASE if kind == "up" else _INVERSE, np.uint64)
        factor[0] = 1
        _powers[kind] = have = np.multiply.accumulate(factor)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = np.array(x, np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str = "text", budget: int = SLICE_BYTES):
    """(rows of the batch, their bytes end to end, where each begins and the end), whole texts only; null: empty."""
    texts = batch.column(column)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
    held = texts.buffers()[2] if n else None
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + budget, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def byte_hashes(buffer: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hashes() reads any span's hash."""
    sums = np.zeros(len(buffer) + 1, np.uint64)
    if len(buffer):
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * _power("up", len(buffer)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = (sums[ends] - sums[starts]) * _power("down", len(sums) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(buffer: np.ndarray, begins: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; no word runs over from one text to the next."""
    n = len(buffer)
    outside = np.ones(n + 1, bool)
    outside[:n] = blank[buffer]
    breaks = np.zeros(n + 1, bool)
    breaks[begins] = True
    before = np.ones(n + 1, bool)
    before[1:] = outside[:-1]
    starts = np.flatnonzero(~outside & (before | breaks))
    ends = np.flatnonzero(~before & (outside | breaks))
    return starts, ends


def words_of(buffer: np.ndarray, begins: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word once A-Z is lower-cased, and the index of each text's first word (one more at the end)."""
    starts, ends = word_spans(buffer, begins, blank)
    return span_hashes(byte_hashes(LOWER[buffer]), starts, ends), np.searchsorted(starts, begins)


def shingle_sets(buffer: np.ndarray, begins: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `width` words in a row; fewer words: one hash of all; no word: empty."""
    words, first = words_of(buffer, begins)
    step = np.uint64(0xA24BAED4963EE407)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled *= step
        rolled += words[k : len(rolled) + k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            one = np.sort(rolled[a : b - width + 1])
            keep = np.ones(len(one), bool)
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            out.append(one[keep])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for x in words[a:b]:
                whole = whole * step + x
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(rolled[:0])
    return out
