"""Benchmark decontamination by latent semantic retrieval.

1. Every document becomes the sequence of its words that some benchmark item has, with their places.
   Other words can neither match an item nor weigh anything.
2. Passages are windows of 2 * STRIDE words, one every STRIDE words. Items are cut into passages of the
   same length, evenly spaced from start to end; a shorter item is one passage. Document frequencies of
   the terms are counted over all passages; terms in more than MAX_SHARE of them carry no weight, but
   every passage of an item keeps its KEEP rarest terms.
3. A distributed randomised SVD of the normalised TF-IDF passages A: each task adds up A'(A R) for a random
   matrix R of RANK + OVERSAMPLE columns, the sums meet per term, and a small factorisation of this sketch gives
   the RANK leading right singular vectors by their singular values.
4. Passages whose weight suffices are projected and compared with all passages of items by cosine, in
   blocks; those over MIN_COSINE are candidates for the item.
5. In the surroundings of a candidate the longest common subsequence with the item is taken. At COPY of the
   item's words it is a copy; from PARAPHRASE on it is one if the item's answer is also there: its last
   words after "answer:", or else its KEEP rarest terms.

The benchmark may have any number of items: the driver holds their words. Steps 3 to 5 run for BLOCK
passages of items at a time, each block with its own broadcast, and all findings are put together.

Defined cases: null and empty texts and items never match; items without words are left out; an item
that occurs several times in a document gives one row, with its best match; repeated rows of a document give one
row; a row with a null id gives a row with a null id; ids are integers; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcube.llm.common import chunks, settle, ship
from parcelcube.llm.shingles import word_hashes

STRIDE, RANK, OVERSAMPLE, MAX_SHARE, KEEP, BLOCK = 16, 64, 8, 0.01, 3, 2_000
MIN_WEIGHT, MIN_COSINE, COPY, PARAPHRASE = 0.35, 0.45, 0.8, 0.6

#: Bytes of text hashed at a time; the arrays in between take about fifty times as much.
HASH_BYTES = 500_000
#: Passages projected at a time.
AT_ONCE = 4096


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of many texts, some at a time."""
    found = [(a, word_hashes(texts[a:b], plain=True)) for a, b in chunks(texts, HASH_BYTES)]
    return np.concatenate([np.zeros(0, np.uint64), *[h for _, (h, _) in found]]), np.concatenate([np.zeros(0, np.int64), *[o + a for a, (_, o) in found]])


def items_of(listed: list[tuple[int, str]]) -> tuple[Terms, list[tuple[int, np.ndarray, set[int]]]]:
    """The terms of the items, and for each item with words: its id, its terms in order and those of its answer."""
    hashes, owner = hashed([t.encode() for _, t in listed])
    unique, numbers = np.unique(hashes, return_inverse=True)
    tails = [re.split(r"(?i)\banswer\s*:", t) for _, t in listed]
    answer, holder = hashed([(t[-1] if len(t) > 1 else "").encode() for t in tails])
    answer = np.searchsorted(unique, answer)
    cuts, ends = (np.searchsorted(o, np.arange(len(listed) + 1)) for o in (owner, holder))
    return Terms(unique), [(i, numbers[cuts[n] : cuts[n + 1]], set(answer[ends[n] : ends[n + 1]].tolist())) for n, (i, _) in enumerate(listed) if cuts[n + 1] > cuts[n]]


class Terms:
    """Word hashes of the benchmark, numbered; a bitmap turns most other words away."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.hashes >> np.uint64(44)] = True

    def encode(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each text: number of words, places and numbers of its terms."""
        words, owner = word_hashes(texts, plain=True)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        maybe = np.flatnonzero(self.bitmap[words >> np.uint64(44)])
        number = np.minimum(np.searchsorted(self.hashes, words[maybe]), len(self.hashes) - 1)
        real = self.hashes[number] == words[maybe]
        maybe, number = maybe[real], number[real].astype(np.int32)
        inside = np.searchsorted(maybe, cuts)
        for a, b, s, e in zip(cuts[:-1], cuts[1:], inside[:-1], inside[1:], strict=True):
            yield b - a, (maybe[s:e] - a).astype(np.int32), number[s:e]


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


class Batch:
    """Weighted terms of the passages of some documents: sorted by passage, with the bounds of each.

    number has the row of idf of each term, or -1 for terms that carry no weight.
    """

    def __init__(self, batch: pa.RecordBatch, idf: np.ndarray, number: np.ndarray) -> None:
        self.all_ids, sizes = flat(batch.column("ids"))
        self.places = flat(batch.column("places"))[0]
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        last = np.maximum(-(-batch.column("n_words").to_numpy().astype(np.int64) // STRIDE) - 2, 0)  # a document's last window
        self.passages = int((last + 1).sum())
        ids = number[self.all_ids]
        use = np.flatnonzero(ids >= 0)
        ids, at = ids[use].astype(np.int64), self.places[use] // STRIDE
        doc = np.repeat(np.arange(len(sizes)), sizes)[use]
        # a code holds document, window and term; a word stands in the windows that start at its stride and at the one before
        hi, lo, size = np.minimum(at, last[doc]), np.clip(at - 1, 0, last[doc]), len(idf)
        head = doc * (int(last.max(initial=0)) + 1)
        two = hi > lo
        codes = np.concatenate([(head + hi) * size + ids, (head[two] + lo[two]) * size + ids[two]])
        codes.sort()
        codes = codes[np.diff(codes, prepend=-1) != 0]
        key = codes // size
        self.ids = codes - key * size
        self.starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.sizes = np.diff(np.append(self.starts, len(key)))
        self.row = np.repeat(np.arange(len(self.starts)), self.sizes)
        wide = int(last.max(initial=0)) + 1
        self.doc, self.window = key[self.starts] // wide, key[self.starts] % wide
        weight = idf[self.ids]
        self.norm = np.sqrt(np.add.reduceat(weight**2, self.starts)) if len(self.starts) else np.zeros(0)
        self.weight = (weight / self.norm[self.row]).astype(np.float32)

    def project(self, base: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The passages numbered in rows times base: their first terms, their second ones, and so on; they have few."""
        starts, sizes = self.starts[rows], self.sizes[rows]
        out = base[self.ids[starts]] * self.weight[starts, None]
        more, nth = np.flatnonzero(sizes > 1), 1
        while len(more):
            at = starts[more] + nth
            out[more] += base[self.ids[at]] * self.weight[at, None]
            nth += 1
            more = more[sizes[more] > nth]
        return out


def cut(words: np.ndarray) -> list[np.ndarray]:
    """An item's passages: of a window's length and at most that far apart, the last one up to its end."""
    beyond, steps = len(words) - 2 * STRIDE, -(-len(words) // (2 * STRIDE)) - 1
    return [words[beyond * k // steps :][: 2 * STRIDE] for k in range(steps + 1)] if steps > 0 else [words]


class Rows:
    """Weighted terms of the items' passages: a sparse matrix, sorted by passage."""

    def __init__(self, passages: list[np.ndarray], idf: np.ndarray) -> None:
        sets = [np.unique(p) for p in passages]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.terms, self.row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        self.starts = np.cumsum(sizes) - sizes
        self.norm = np.sqrt(np.add.reduceat(idf[self.terms] ** 2, self.starts))
        self.weight = (idf[self.terms] / self.norm[self.row]).astype(np.float32)

    def __len__(self) -> int:
        return len(self.starts)

    def project(self, base: np.ndarray) -> np.ndarray:
        return np.add.reduceat(base[self.terms] * self.weight[:, None], self.starts)

    def back(self, values: np.ndarray, n_terms: int) -> np.ndarray:
        """The transposed matrix times values."""
        return np.column_stack([np.bincount(self.terms, weights=self.weight * values[self.row, j], minlength=n_terms) for j in range(values.shape[1])])


def common_length(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, a row of the table per word as bits of a number."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        y = v & masks.get(w, 0)
        v = ((v + y) | (v - y)) & full
    return len(item) - v.bit_count()


def _encoded(docs: DataFrame, terms: Terms) -> DataFrame:
    """(id, text) -> (id, n_words, places, ids)."""
    shared = ship(docs.sparkSession, terms)

    @F.pandas_udf("n_words int, places array<int>, ids array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in parts:
            texts = [t.encode("utf-8", "replace") if t else b"" for t in series]
            found = [x for a, b in chunks(texts, HASH_BYTES) for x in shared.value.encode(texts[a:b])]
            yield pd.DataFrame({"n_words": [n for n, _, _ in found], "places": [p for _, p, _ in found], "ids": [i for _, _, i in found]})

    return docs.withColumn("e", encode("text")).select("id", "e.*")


def _frequencies(encoded: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and all passages."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(n_terms, np.int64), 0
        for part in parts:
            batch = Batch(part, np.ones(n_terms), np.arange(n_terms))
            total += np.bincount(batch.ids, minlength=n_terms)
            passages += batch.passages
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(np.flatnonzero(total), -1), pa.int32()), "n": pa.array(np.append(total[total > 0], passages), pa.int64())})

    out = np.zeros(n_terms + 1, np.int64)
    for r in encoded.select("n_words", "places", "ids").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def leading(start: np.ndarray, sums: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of A, by falling singular value, from start (random) and sums = A'(A start).

    The factorisation of a sketch by Nystrom's method: sums (start' sums)^-1 sums' is near A'A, and its factors come from a
    Cholesky decomposition and a small singular value decomposition. Directions without weight are left out.
    """
    shift = np.finfo(float).eps * np.linalg.norm(sums) * len(start) ** 0.5 + 1e-300
    sums = sums + shift * start
    gram = start.T @ sums
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    values = np.maximum(values, values.max() * 1e-12)
    left, singular, _ = np.linalg.svd(sums @ (turn / np.sqrt(values)), full_matrices=False)
    weight = np.maximum(singular**2 - shift, 0)
    return left[:, : max(1, min(rank, int((weight > weight[0] * 1e-9).sum())))]


def _base(encoded: DataFrame, idf: np.ndarray, number: np.ndarray, items: Rows, passages: int, rank: int, seed: int = 17) -> np.ndarray:
    """Orthonormal base (terms, rank) of the leading right singular space of the TF-IDF passages.

    The items' passages count too, weighted to count as much as all those of the documents.
    """
    rank, wide = min(rank, len(idf)), min(rank + OVERSAMPLE, len(idf))
    start = np.random.default_rng(seed).normal(size=(len(idf), wide)).astype(np.float32)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(idf), wide))
        for part in parts:
            batch = Batch(part, idf, number)
            for a in range(0, len(batch.starts), AT_ONCE):
                rows = np.arange(a, min(a + AT_ONCE, len(batch.starts)))
                own = slice(batch.starts[a], batch.starts[rows[-1]] + batch.sizes[rows[-1]])
                back = np.ascontiguousarray((batch.project(start, rows)[batch.row[own] - a] * batch.weight[own, None]).T)
                for j in range(wide):
                    total[:, j] += np.bincount(batch.ids[own], weights=back[j], minlength=len(idf))
        seen = np.flatnonzero(total.any(1))
        if len(seen):
            offsets = pa.array(np.arange(len(seen) + 1) * wide, pa.int32())
            yield pa.RecordBatch.from_pydict({"term": pa.array(seen, pa.int32()), "v": pa.ListArray.from_arrays(offsets, pa.array(total[seen].ravel()))})

    sums = encoded.select("n_words", "places", "ids").mapInArrow(add, "term int, v array<double>").groupBy("term").agg(*[F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(wide)])
    out = np.zeros((len(idf), wide))
    found = sums.toPandas()  # one row per term of the block
    out[found["term"].to_numpy(int)] = found.drop(columns="term").to_numpy(float)
    out += passages / len(items) * items.back(items.project(start), len(idf))
    return leading(start.astype(float), out, rank).astype(np.float32)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK) -> DataFrame:
    """Returns one row per document and benchmark item found in it: id_col, item_col, matched (share of the item's words), cosine, kind (copy or paraphrase)."""
    spark = docs.sparkSession
    listed = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t IS NOT NULL").distinct().orderBy("i", "t").toLocalIterator()
    terms, items = items_of([(r["i"], r["t"]) for r in listed])
    if not items:
        return spark.createDataFrame([], f"{id_col} long, {item_col} long, matched double, cosine double, kind string")
    encoded = settle(_encoded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), terms))
    df, passages = _frequencies(encoded, len(terms.hashes))
    raw = np.log((passages + 1) / (df + 0.5))
    idf = np.where(df <= max(MAX_SHARE * passages, 2), raw, 0)
    parts = [(n, p) for n, (_, words, _) in enumerate(items) for p in cut(words)]
    rarest = lambda words: np.unique(words)[np.argsort(df[np.unique(words)], kind="stable")[:KEEP]]
    for _, passage in parts:
        idf[rarest(passage)] = raw[rarest(passage)]
    items = [(i, words, answer or set(rarest(words).tolist())) for i, words, answer in items]
    found = []
    for k in range(0, len(parts), BLOCK):
        owner, own = zip(*parts[k : k + BLOCK], strict=True)
        found.append(_search(encoded, idf, list(own), np.array(owner) - owner[0], items[owner[0] : owner[-1] + 1], passages, rank, len(parts) > BLOCK))
    while len(found) > 1:  # a shallow tree
        found = [a.union(b) for a, b in zip(found[::2], found[1::2], strict=False)] + found[len(found) // 2 * 2 :]
    found = found[0].groupBy("id", "item").agg(F.max("matched").alias("matched"), F.max("cosine").alias("cosine"))
    kind = F.when(F.col("matched") >= COPY, "copy").otherwise("paraphrase")
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matched", "cosine", kind.alias("kind"))


def _search(encoded: DataFrame, idf: np.ndarray, own: list[np.ndarray], owner: np.ndarray, items: list[tuple[int, np.ndarray, set[int]]], passages: int, rank: int, kept: bool) -> DataFrame:
    """(id, item, matched, cosine) of one block: the passages own, of the items numbered in owner. kept: the findings are written and the broadcast given up."""
    used = np.unique(np.concatenate(own))
    used = used[idf[used] > 0]
    number = np.full(len(idf), -1, np.int32)
    number[used] = np.arange(len(used))
    idf = idf[used]
    rows = Rows([number[p][number[p] >= 0] for p in own], idf)
    base = _base(encoded, idf, number, rows, passages, rank)
    vectors = rows.project(base)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    shared = ship(encoded.sparkSession, (idf, number, base, vectors, rows.norm, owner, [(i, w.tolist(), answer) for i, w, answer in items]))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, number, base, vectors, weights, owner, items = shared.value
        for part in parts:
            batch, out, whole = Batch(part, idf, number), [], set()
            keep = np.flatnonzero(batch.norm >= MIN_WEIGHT * weights.min())
            names = part.column("id").to_pylist()
            for a in range(0, len(keep), AT_ONCE):
                rows = keep[a : a + AT_ONCE]
                projected = batch.project(base, rows)
                projected /= np.maximum(np.linalg.norm(projected, axis=1, keepdims=True), 1e-9)
                cosine = projected @ vectors.T
                near = (cosine >= MIN_COSINE) & (batch.norm[rows][:, None] >= MIN_WEIGHT * weights)
                r, j = np.nonzero(near)
                first = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(owner[j], prepend=-1) != 0))  # each item once per window
                best = np.maximum.reduceat(cosine[r, j], first) if len(first) else cosine[:0, 0]
                for row, n, value in zip(rows[r[first]].tolist(), owner[j[first]].tolist(), best.tolist(), strict=True):
                    doc, window, (item, words, answer) = int(batch.doc[row]), int(batch.window[row]), items[n]
                    if (doc, n) in whole:  # no other match is better
                        out.append((names[doc], item, 1.0, value))
                        continue
                    start, end = batch.bounds[doc], batch.bounds[doc + 1]
                    lo, hi = start + np.searchsorted(batch.places[start:end], (window * STRIDE - len(words), (window + 2) * STRIDE + len(words)))
                    around = batch.all_ids[lo:hi].tolist()
                    seen = set(around)
                    if sum(w in seen for w in words) / len(words) < PARAPHRASE:  # bounds the common subsequence
                        continue
                    share = common_length(words, around) / len(words)
                    if share == 1:
                        whole.add((doc, n))
                    if share >= COPY or (share >= PARAPHRASE and answer <= seen):
                        out.append((names[doc], item, share, value))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"id": pa.array(columns[0], pa.int64()), "item": pa.array(columns[1], pa.int64()), "matched": pa.array(columns[2], pa.float64()), "cosine": pa.array(columns[3], pa.float64())})

    found = encoded.mapInArrow(search, "id long, item long, matched double, cosine double")
    if kept:
        found = settle(found)
        shared.unpersist()
    return found
