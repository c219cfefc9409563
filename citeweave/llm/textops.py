"""Vectorised text kernels over many documents at once: words, hashes, shingles, n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
# Fixed value: white space is these bytes and no others; letters A-Z are lower-cased and no others.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
# Fixed value: letters and digits are 0-9, A-Z, a-z and every byte of a non-ASCII character.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of several documents: byte places in ``raw``, owner document, and a hash of the lower-cased word."""

    raw: np.ndarray
    doc_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def word_spans(texts: list[bytes], inside: np.ndarray = ~SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(raw bytes, document starts, word starts, word ends, word owners) of runs of the bytes marked in ``inside``."""
    sizes = np.array([len(t) for t in texts], np.int64)
    doc_start = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    full = inside[raw]
    before = np.concatenate([[False], full[:-1]]) if len(raw) else full
    inner = doc_start[:-1][sizes > 0]
    if len(inner):
        before[inner] = False
    start = np.nonzero(full & ~before)[0]
    after = np.concatenate([full[1:], [False]]) if len(raw) else full
    if len(inner):
        after[doc_start[1:][sizes > 0] - 1] = False
    end = np.nonzero(full & ~after)[0] + 1
    return raw, doc_start, start, end, np.searchsorted(doc_start, start, side="right") - 1


def words_of(texts: list[bytes], inside: np.ndarray = ~SPACES) -> Words:
    """Split documents into words and hash them; words never span documents."""
    raw, doc_start, start, end, doc = word_spans(texts, inside)
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * inverse[: len(raw)])])
    return Words(raw, doc_start, start, end, doc, mix64((sums[end] - sums[start]) * power[end]))


def shingles(words: Words, count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offset per document): each document's distinct ``size``-word shingles, sorted by hash.

    A document with fewer words has its whole sequence as its one shingle; one
    without words has none.
    """
    per_doc = np.bincount(words.doc, minlength=count).astype(np.int64)
    rolled = np.zeros(len(words.hash), np.uint64)
    factors = [mix64(np.array([j + 1], np.uint64))[0] | np.uint64(1) for j in range(size)]
    for j in range(size):
        rolled[: len(rolled) - j] += words.hash[j:] * factors[j]
    first = np.concatenate([[0], np.cumsum(per_doc)])
    position = np.arange(len(words.hash)) - first[words.doc]
    whole = position <= (per_doc[words.doc] - size)
    hashes, owner = mix64(rolled[whole]), words.doc[whole]
    few = np.nonzero((per_doc > 0) & (per_doc < size))[0]
    if len(few):
        short = []
        for d in few:
            h = int(per_doc[d])
            for x in words.hash[first[d] : first[d + 1]].tolist():
                h = int(mix64(np.array([h * int(_P) + x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])
            short.append(h)
        hashes, owner = np.concatenate([hashes, np.array(short, np.uint64)]), np.concatenate([owner, few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=count))]).astype(np.int64)


def gram_buckets(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Hash buckets of all character n-grams of the given lengths (with repeats)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, rolled = [], codes * _P
    for n in range(2, max(sizes) + 1):
        if len(codes) < n:
            break
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * _P + codes[n - 1 :]
        if n in sizes:
            out.append((((rolled ^ (rolled >> np.uint64(32))) * _P) >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)
