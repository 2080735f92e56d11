"""Word shingles of whole texts as 64-bit hashes, worked out over the raw bytes of many texts at once.

Words are runs of bytes other than space and \\t\\n\\v\\f\\r, with A-Z lower-cased; a shingle is k words in
a row; with fewer words the whole sequence is one shingle; without words there is none.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_APART = _SPACE.copy()
_APART[[c for c in range(128) if not chr(c).isalnum()]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULT)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = np.uint64(base)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * step])
            step = step * step
    return out[:n]


_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWER = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def word_hashes(texts: list[bytes], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the text it stands in, in order. plain: words end at ASCII punctuation too."""
    joined = b" ".join([*texts, b""])
    data = _LOWER[np.frombuffer(joined, np.uint8)]
    n = len(data)
    if len(_POWER["up"]) < n:
        _POWER["up"], _POWER["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    space = (_APART if plain else _SPACE)[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    ends_at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _POWER["up"][:n], dtype=np.uint64)])
        hashes = mix((total[end] - total[start]) * _POWER["down"][start] + (end - start).astype(np.uint64) * _MULT)
    return hashes, np.searchsorted(ends_at, start, "right")


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hashes, and the bounds of each text among them (len(texts) + 1)."""
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        code = np.zeros(len(words), np.uint64)
        for j in range(k):  # a shingle is held by its first word; beyond the end of a text words count as none
            here = np.zeros(len(words), np.uint64)
            if len(words) > j:
                same = owner[j:] == owner[: len(owner) - j]
                here[: len(words) - j] = np.where(same, words[j:], 0)
            code = mix(code * _MULT + here + np.uint64(j + 1))
    first = np.cumsum(counts) - counts
    nth = np.arange(len(words)) - np.repeat(first, counts)
    code = code[(nth + k <= np.repeat(counts, counts)) | (nth == 0)] if len(words) else code
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    parts = [np.unique(code[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    kept = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), kept


def super_minhash(elements: np.ndarray, bounds: np.ndarray, m: int, seed: int = 1) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017) of the sets elements[bounds[i]:bounds[i+1]].

    Every element deals the values j + r_j, j = 0, 1, ..., to positions in the order of its own random
    permutation; a position keeps its least value. After round j only positions without a value can
    still change, so a set stops as soon as all positions have one. Empty sets keep +inf.
    """
    n_sets = len(bounds) - 1
    out = np.full((n_sets, m), np.inf)
    sizes = np.diff(bounds)
    budget = 20_000
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    cuts = np.cumsum(sizes[order]) // budget
    for chunk in np.split(order, np.flatnonzero(np.diff(cuts)) + 1) if len(order) else ():
        values = np.concatenate([elements[bounds[i] : bounds[i + 1]] for i in chunk])
        owner = np.repeat(np.arange(len(chunk)), sizes[chunk])
        sig = np.full(len(chunk) * m, np.inf)
        perm = None
        for j in range(m):
            with np.errstate(over="ignore"):
                draw = mix(values + np.uint64(((2 * j + 1) * 0xA24BAED4963EE407 + seed) & 0xFFFFFFFFFFFFFFFF))
            k = j + ((draw >> np.uint64(40)) * np.uint64(m - j) >> np.uint64(24)).astype(np.int64)
            r = (draw & np.uint64((1 << 40) - 1)).astype(float) / (1 << 40)
            if perm is None:  # the first draw meets the identity; permutations are built only where a second is due
                at = k
                first = k
            else:
                rows = np.arange(len(values))
                at = perm[rows, k].astype(np.int64)
                perm[rows, k] = perm[rows, j]
                perm[rows, j] = at
            np.minimum.at(sig, owner * m + at, r + j)
            open_sets = np.isinf(sig.reshape(-1, m)).any(1)
            if not open_sets.any():
                break
            stay = open_sets[owner]
            values, owner = values[stay], owner[stay]
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.int16), (len(values), 1))
                rows, k0 = np.arange(len(values)), first[stay]
                perm[rows, 0] = k0
                perm[rows, k0] = 0
            elif not stay.all():
                perm = perm[stay]
        out[chunk] = sig.reshape(-1, m)
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """(sets, bands) keys; equal keys mean equal values all over the band."""
    n, m = signatures.shape
    parts = signatures.view(np.uint64).reshape(n, bands, m // bands)
    out = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
    with np.errstate(over="ignore"):
        for k in range(m // bands):
            out = mix(out * _MULT + parts[:, :, k])
    return out.view(np.int64)
