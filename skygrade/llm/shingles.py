"""Words and word sequences as 64-bit hashes, computed on whole Arrow batches."""

import numpy as np
from xxhash import xxh3_64_digest

BASE = np.uint64(0x9E3779B97F4A7C15)
SHORT = np.uint64(0xD1B54A32D192ED03)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxh3_64_digest, words)), np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all input bits over all output bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_powers = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and their inverses, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        up, down = np.full(size, base), np.full(size, np.uint64(pow(int(base), -1, 1 << 64)))
        up[0] = down[0] = 1
        known = _powers[base] = np.cumprod(up), np.cumprod(down)
    return known[0][:n], known[1][:n]


def stretches(hashes: np.ndarray, start, end, base=BASE) -> np.ndarray:
    """Hash of the words from each start up to each end: differences of running sums, shifted to a common power."""
    up, down = powers(base, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mixed((total[end] - total[start]) * down[start])


def runs(hashes: np.ndarray, k: int, base=BASE) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    return stretches(hashes, slice(0, n), slice(k, n + k), base)


def shingle_set(words: list[bytes], k=5) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of fewer words the whole sequence is one; of none it is empty."""
    hashes = word_hashes(words)
    if len(hashes) >= k:
        return np.unique(runs(hashes, k))
    if not len(hashes):
        return np.empty(0, np.uint64)
    return runs(hashes, len(hashes)) ^ (mixed(np.array([len(hashes)], np.uint64)) | SHORT)
