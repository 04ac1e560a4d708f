"""Plain words of many texts as numbers, for set similarity over Arrow batches.

A batch of texts becomes one flat array of 64-bit word hashes with offsets.
Distinct raw words are few, so each is brought to its plain form once per
Python worker and remembered; the memory is emptied when it grows too large.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import xxhash

from kalamos.llm.lookalike import plain_words

REMEMBERED = 500_000
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


class WordHashes:
    """Raw blank-separated piece -> hashes of its plain words (mostly one)."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in text.split():
            found = known.get(piece)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[piece] = tuple(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in plain_words(piece))
            out += found
        return out

    def batch(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat hashes and the offsets of the texts in them (one more than texts)."""
        rows = [self(t) for t in texts]
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        flat = np.fromiter((h for r in rows for h in r), _U, int(offsets[-1]))
        return flat, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over all 64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def row_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def bags(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens (word, how-manyth occurrence in its row), sorted within each row: multisets become sets."""
    rows = row_of(offsets)
    order = np.lexsort((flat, rows))
    word, row = flat[order], rows[order]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(word)), 0))
    return mix(word + (np.arange(len(word)) - start).astype(_U) * _GOLD)


def per_row(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty: int) -> np.ndarray:
    """``ufunc`` reduced over each row; ``empty`` where a row has nothing."""
    out = np.full(len(offsets) - 1, empty, values.dtype)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = ufunc.reduceat(values, offsets[:-1][full])
    return out


def signatures(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit number per row; equal for equal bags."""
    return mix(per_row(np.add, mix(tokens ^ _GOLD), offsets, 0) + np.diff(offsets).astype(_U) * _GOLD)


def sequence_signatures(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit number per row; equal for equal word sequences."""
    place = (np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(_U)
    return signatures(mix(flat + place * _GOLD), offsets)


def sketches(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Size << 48 | 48-bit parity sketch.  Two bags that differ in d tokens differ in at most d bits, so more
    differing bits than a similarity allows prove a pair to be below it: the filter loses nothing.  Sizes are
    counted up to 32767; nothing is rejected for bags of that size."""
    bit = _U(1) << ((tokens >> _U(16)) % _U(48))
    size = np.minimum(np.diff(offsets), 32767).astype(_U)
    return ((size << _U(48)) | per_row(np.bitwise_xor, bit, offsets, 0)).view(np.int64)


def parities(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A second parity sketch, of 64 other bits and without the size."""
    return per_row(np.bitwise_xor, _U(1) << (mix(tokens ^ (_GOLD << _U(1))) >> _U(58)), offsets, 0).view(np.int64)


def sketch_condition(one: str, other: str, share: float) -> str:
    """SQL: the two sketches do not prove the common share to be below ``share``."""
    most = f"{1 - share} * (shiftright({one}, 48) + shiftright({other}, 48)) + 1e-9"
    return f"(bit_count(({one} ^ {other}) & 281474976710655L) <= {most} or shiftright({one}, 48) = 32767 or shiftright({other}, 48) = 32767)"


def minima(tokens: np.ndarray, offsets: np.ndarray, seeds: Sequence[int]) -> np.ndarray:
    """MinHash values, one line per seed; rows must not be empty."""
    with np.errstate(over="ignore"):
        return np.stack([np.minimum.reduceat(mix(tokens ^ mix(np.array([s], _U) * _GOLD)), offsets[:-1]) for s in seeds])


def prefix_keys(tokens: np.ndarray, offsets: np.ndarray, share: float, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and their rows, that two bags of the common share must have in common.

    Bags with ``common`` words in common agree in two of the first ``n - common + 2`` words of either in any fixed
    order, here that of the hashes; ``common`` is what a bag of ``n`` words needs with the smallest bag that can reach
    the share.  Where one common word is enough, single words are keys as well.  Bags of more than ``longest`` words
    give keys only as far as they can reach the share with one of at most ``longest``."""
    sizes = np.diff(offsets)
    rows = row_of(offsets)
    tokens = tokens[np.lexsort((tokens, rows))]
    most = math.inf if longest is None else math.floor(longest * (2 - share) / share + 1e-9)
    values, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for n in np.unique(sizes[(sizes > 0) & (sizes <= most)]).tolist():
        own = np.flatnonzero(sizes == n)
        common = max(1, math.ceil(share * n / (2 - share) - 1e-9))
        first, second = np.triu_indices(min(n, n - common + 2), 1)
        for start in range(0, len(own), max(1, 4_000_000 // max(1, len(first)))):
            part = own[start : start + max(1, 4_000_000 // max(1, len(first)))]
            words = tokens[offsets[part][:, None] + np.arange(n)[None, :]]
            if common == 1:
                values.append(mix(words + _U(7)).ravel())
                owners.append(np.repeat(part, n))
            values.append(mix(words[:, first] * _U(31) + mix(words[:, second] + _U(11))).ravel())
            owners.append(np.repeat(part, len(first)))
    return np.concatenate(values), np.concatenate(owners)
