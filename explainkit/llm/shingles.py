"""Word hashes and word-shingle hashes as arrays."""

from __future__ import annotations

import numpy as np

from explainkit.llm.common import Memo, ascii_words

#: Words of a shingle.
WORDS = 5
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_memo = Memo()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case."""
    import xxhash

    words = ascii_words(text)
    _memo.touch()
    try:
        return np.fromiter(map(_memo.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        new = [w for w in set(words) if w not in _memo]
        for w in new:
            _memo[w] = xxhash.xxh64_intdigest(w)
        out = np.fromiter(map(_memo.__getitem__, words), dtype=np.uint64, count=len(words))
        _memo.settle(sum(map(len, new)) + 30 * len(new))
        return out


def shingle_hashes(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """A 64-bit hash of every ``k``-word shingle; fewer words: the whole sequence; none: empty."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + n - k + 1]) * _PRIME
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))
