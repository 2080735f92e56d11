"""Periodic runs of words by bit-parallel lags.

A run is a stretch of consecutive words with smallest period q and a length of at least `least_length` and `repeats` periods that
no neighbouring word extends. Word numbers of a text are spread over bit planes, one big integer per bit. For a lag q, planes are
XORed with themselves shifted by q and the results ORed: zeros are words equal to those q later. AND with shifts that double leaves
only starts of zero stretches that are long enough, and the ends of these stretches are the ends of runs.

Which lags to try is settled before, exactly, for all texts of an Arrow batch at once. With a gram of k >= q words, a run of period
q shows two equal grams q apart without another in between: a nearer one would, by Fine and Wilf, give the run a period that divides
q. So numbering grams of 16, 32, 64 ... words by doubling, and noting the distances of neighbouring equal grams, finds every lag
that can carry a run, and no text needs all n / 3 of them. Each such distance is itself a repetition, so there are few.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; very long texts are handled whole; equal
rows are judged each; ids of any type stay as they are, null ones too; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcube.llm.common import bounded, chunks

#: A run's words at least, and its periods at least.
LEAST_LENGTH, REPEATS = 24, 3


def numbers(items: np.ndarray) -> np.ndarray:
    """Dense numbers of equal items."""
    return np.unique(items, return_inverse=True)[1].astype(np.int64)


def repeated(at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose name is not the only one of its kind, with dense names."""
    if not len(at):
        return at, names
    names = numbers(names)
    kept = np.bincount(names)[names] > 1
    return at[kept], names[kept]


def joined(at: np.ndarray, names: np.ndarray, owner: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of twice `step` words from those of `step` words: both halves must be repeated grams of one text."""
    name_at = np.full(len(owner) + step, -1, np.int64)
    name_at[at] = names
    second = name_at[at + step]
    ok = second >= 0
    ok &= owner[np.minimum(at + step, len(owner) - 1)] == owner[at]
    first, second = names[ok], second[ok]
    return repeated(at[ok], first * (int(names.max(initial=0)) + 1) + second)


def candidate_lags(ids: np.ndarray, owner: np.ndarray, least_length: int, repeats: int) -> dict[int, set[int]]:
    """text -> lags at which it may hold a run. ids: numbers of all words of a batch; owner: the text of each word, rising."""
    found: dict[int, set[int]] = {}
    # a gram of k words at both ends of a lag q <= k fits into least_length words for small lags, into `repeats` periods for others
    k = 1
    while 2 * k <= least_length * (repeats - 1) // repeats:
        k *= 2
    at, names = repeated(np.arange(len(ids)), owner * (int(ids.max(initial=0)) + 1) + ids)
    step, low = 1, 0
    while len(at):
        if step >= k:
            order = np.lexsort((at, names))
            here, next_ = at[order[:-1]], at[order[1:]]
            lag = next_ - here
            ok = (names[order[:-1]] == names[order[1:]]) & (lag > low) & (lag <= step)
            for doc, q in set(zip(owner[here[ok]].tolist(), lag[ok].tolist(), strict=True)):
                found.setdefault(doc, set()).add(q)
            low = step
        at, names = joined(at, names, owner, step)
        step *= 2
    return found


def planes(ids: np.ndarray) -> list[int]:
    """One big integer per bit of the word numbers; bit i belongs to word i."""
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max()).bit_length()))]


def ones(bits: int, n: int) -> np.ndarray:
    """Positions of the ones among the lowest n bits."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))


def prime_factors(q: int) -> list[int]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*found, q] if q > 1 else found


def runs_at(bits: list[int], ids: np.ndarray, q: int, least_length: int, repeats: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs whose smallest period is q."""
    n = len(ids)
    need = max(least_length, repeats * q) - q
    if n - q < need:
        return
    differ = 0
    for plane in bits:
        differ |= plane ^ (plane >> q)
    long = ~differ & ((1 << (n - q)) - 1)
    have = 1
    while have < need and long:
        shift = min(have, need - have)
        long &= long >> shift
        have += shift
    if not long:
        return
    starts, lasts = ones(long & ~(long << 1), n), ones(long & ~(long >> 1), n)
    parts = [q // p for p in prime_factors(q)]
    for s, e in zip(starts.tolist(), lasts.tolist(), strict=True):
        unit = ids[s : s + q]
        if not any(np.array_equal(unit[d:], unit[: q - d]) for d in parts):
            yield s, e - s + need + q, q


def find_runs(docs: list[list[bytes]], least_length: int = LEAST_LENGTH, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, by start, then period."""
    known: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ids = np.fromiter((known.setdefault(w, len(known)) for words in docs for w in words), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(docs)), sizes)
    starts = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for doc, lags in candidate_lags(ids, owner, least_length, repeats).items():
        own = numbers(ids[starts[doc] : starts[doc] + sizes[doc]])
        bits = planes(own)
        out[doc] = sorted((r for q in lags for r in runs_at(bits, own, q, least_length, repeats)), key=lambda r: (r[0], r[2]))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def periodic_runs(df: DataFrame, least_length: int = LEAST_LENGTH, repeats: int = REPEATS, id_col: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """id_col, n_words, runs (start, length, period in words; by start, then period) and collapsed: the words kept, joined by spaces.

    repeats: at least 3, as runs of fewer periods can be too short for the grams that find their lag.
    """
    if repeats < 3 or least_length < 3:
        raise ValueError("runs of fewer than three periods or words are not supported")
    bounded(df.sparkSession)

    rows = df.select(F.col(id_col).alias(id_col), (F.col(text) if isinstance(text, str) else text).alias("__text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            for a, b in chunks(values, 1_000_000):
                docs = [(t or "").encode().split() for t in values[a:b]]  # bytes are split at ASCII white space only
                found = find_runs(docs, least_length, repeats)
                kept = [b" ".join(without_repeats(words, runs)).decode() for words, runs in zip(docs, found, strict=True)]
                ends = np.cumsum([0, *map(len, found)])
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                runs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(map(len, docs)), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), pa.array(kept, pa.string())], [id_col, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(runs_of, f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
