"""Vectorised words and hashes of many texts at once.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters. Words compare in lower case, where A-Z
and the Latin-1 capitals (U+00C0 to U+00DE without U+00D7) count as capitals. `plain_words` is the same in plain Python,
for tests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

PIECE = 1 << 20  # bytes hashed at once; texts are cut into pieces between words, so this bounds memory, not the text
LONG = 256  # bytes of a word from which on a cryptographic hash is taken
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: tuple[np.ndarray, np.ndarray] | None = None
_PLAIN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_FOLD = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF)] if c != 0xD7}


def plain_words(text: str | None) -> list[str]:
    return [w.translate(_FOLD) for w in _PLAIN.findall(text or "")]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def salt(k: int) -> np.uint64:
    """The k-th of a sequence of odd-looking constants."""
    return _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        up, down = np.full(size, _U(_BASE)), np.full(size, _U(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _powers


@dataclass
class Words:
    """Words of a list of texts, in order: text index, hash, and flags that do not depend on the case-folded form."""

    text: np.ndarray  # int64
    hash: np.ndarray  # uint64
    number: np.ndarray  # all ASCII digits
    capital: np.ndarray  # starts with a capital
    opens: np.ndarray  # first word of the text, or after . ! ? or a line end
    n_texts: int

    def starts(self) -> np.ndarray:
        """Index of each text's first word, and at last the number of words."""
        return np.searchsorted(self.text, np.arange(self.n_texts + 1))


def _pieces(texts: Sequence[str | None]) -> Iterator[tuple[int, bytes]]:
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        at = 0
        while len(raw) - at > PIECE:
            cut = at + PIECE
            while cut > at and _IS_WORD[raw[cut - 1]]:
                cut -= 1
            if cut == at:  # one word of over a piece: goes on to its end
                cut = at + PIECE
                while cut < len(raw) and _IS_WORD[raw[cut]]:
                    cut += 1
            yield i, raw[at:cut]
            at = cut
        yield i, raw[at:]


def words(texts: Sequence[str | None]) -> Words:
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, bytes]] = []
    size, last = 0, -1
    for i, raw in _pieces(texts):
        if held and size + len(raw) + 1 > PIECE:
            found.append(_hash_pieces(held, last))
            last, held, size = held[-1][0], [], 0
        held.append((i, raw))
        size += len(raw) + 1
    if held:
        found.append(_hash_pieces(held, last))
    if not found:
        z = np.zeros(0, bool)
        return Words(np.zeros(0, np.int64), np.zeros(0, _U), z, z, z, 0)
    return Words(*(np.concatenate(x) for x in zip(*found, strict=True)), len(texts))


def _hash_pieces(held: list[tuple[int, bytes]], last: int) -> tuple[np.ndarray, ...]:
    """`last`: the text whose earlier part ended the pieces before."""
    b = np.frombuffer(b"\n".join(x for _, x in held) + b"\n", np.uint8)
    ends_at = np.cumsum([len(x) + 1 for _, x in held])
    is_word = _IS_WORD[b]
    before = np.concatenate(([False], is_word[:-1]))
    first = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(~is_word & before)
    low = _LOWER[b]
    latin = np.concatenate(([False], b[:-1] == 0xC3)) & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
    low[latin] += 32
    up, down = powers(len(b) + 1)
    s = np.concatenate((np.zeros(1, _U), np.cumsum(_VALUE[low] * up[: len(b)], dtype=_U)))
    h = mix((s[end] - s[first]) * down[first] + (end - first).astype(_U))
    for i in np.flatnonzero(end - first > LONG):  # a polynomial modulo 2**64 cannot tell some long words apart, whatever its base
        h[i] = int.from_bytes(hashlib.blake2b(low[first[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    where = np.searchsorted(ends_at, first, "right")
    text = np.array([i for i, _ in held], np.int64)[where]
    digits = np.concatenate(([0], np.cumsum((b >= 48) & (b < 58))))
    number = digits[end] - digits[first] == end - first
    capital = ((b[first] >= 65) & (b[first] < 91)) | np.concatenate((latin, [False]))[first + 1]
    stops = np.concatenate(([0], np.cumsum((b == 46) | (b == 33) | (b == 63) | (b == 10))))
    opens = np.ones(len(first), bool)
    if len(first):
        opens[1:] = (stops[first[1:]] > stops[end[:-1]]) | (text[1:] != text[:-1])
        opens[0] = text[0] != last
    return text, h, number, capital, opens


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of n words; a text of 1 to n-1 words has one run: all its words."""
    at, count = w.starts(), len(w.hash)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    coef = mix(np.arange(11, 11 + n, dtype=_U))
    inside = np.flatnonzero(np.concatenate((w.text[n - 1 :] == w.text[: max(0, count - n + 1)], np.zeros(min(n - 1, count), bool))))
    h = np.zeros(len(inside), _U)
    for k in range(n):
        h += w.hash[inside + k] * coef[k]
    text = w.text[inside]
    lens = np.diff(at)
    short = np.flatnonzero((lens > 0) & (lens < n))
    extra = np.array([_short(w.hash[at[i] : at[i + 1]], coef) for i in short], _U)
    text, h = np.concatenate((text, short)), mix(np.concatenate((h, extra)))
    order = np.argsort(text, kind="stable")
    return text[order], h[order]


def _short(h: np.ndarray, coef: np.ndarray) -> np.uint64:
    return np.add((h * coef[: len(h)]).sum(keepdims=True, dtype=_U), np.uint64(len(h) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))[0]


def chunks(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Slices of consecutive items of at most `most` bytes together; an item above it stands alone."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(at, i)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield slice(at, len(sizes))
