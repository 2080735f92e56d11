"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text forwards and backwards, across words, and labels every byte position with
language probabilities; a document's probabilities are the mean over all its positions. A text is read in windows of CORE
bytes, each with MARGIN bytes more on both sides to bring the states up, so whole texts of any length are read in
bounded memory, and a position is labelled from at least MARGIN bytes of its text around it.

It is trained here, in numpy, by backpropagation through time with Adam. Every stretch of TRAIN_CHARS characters of
every labelled text is a row to choose from; about TRAIN_ROWS of them per language are drawn by a hash of the text and of their place,
and put in order before fitting, so the weights do not depend on partitions.

Defined cases: a null text or one without letters is `und` with score 0; without any training row
every document is `und`; equal probabilities go to the alphabetically first language; repeated rows
are labelled each; an empty table gives an empty result; other columns pass through with_language(), and
its own are put beside them under `names`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcube.llm.common import chunks, ship

HIDDEN, CORE, MARGIN = 8, 240, 16
TRAIN_ROWS, TRAIN_CHARS, EPOCHS, BATCH = 1_500, 96, 2, 24
#: Windows read at a time, and characters of text cut into windows at a time.
AT_ONCE, CHUNK = 1_024, 500_000
PAD = 256
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Direction:
    """One gated recurrent unit; gates z, r, n lie one below the other. PAD keeps the state."""

    def __init__(self, rng: np.random.Generator, hidden: int) -> None:
        self.x = rng.normal(0, 0.3, (3 * hidden, 257)).astype(np.float32)
        self.x[:, PAD] = np.repeat(np.float32([40, 0, 0]), hidden)
        self.u = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
        self.hidden = hidden

    def forward(self, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """data: (time, windows) -> states (time, hidden, windows). The half in the sigmoids' arguments is left to the weights."""
        d, wide, kind = self.hidden, data.shape[1], self.u.dtype
        state = np.zeros((d, wide), kind)
        out, trace = np.empty((len(data), d, wide), kind), []
        x, h, n = np.empty((3 * d, wide), kind), np.empty((3 * d, wide), kind), np.empty((d, wide), kind)
        for t, column in enumerate(data):
            np.take(self.x, column, axis=1, out=x)
            np.matmul(self.u, state, out=h)
            gates = x[: 2 * d]
            gates += h[: 2 * d]
            _sigmoid(gates)
            np.multiply(gates[d:], h[2 * d :], out=n)
            n += x[2 * d :]
            np.tanh(n, out=n)
            if keep:
                trace.append((state, gates[:d].copy(), gates[d:].copy(), n.copy(), h[2 * d :].copy()))
            np.subtract(state, n, out=out[t])
            out[t] *= gates[:d]
            out[t] += n
            state = out[t]
        return out, trace

    def backward(self, data: np.ndarray, trace: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gx, gu = np.zeros_like(self.x.T), np.zeros_like(self.u)
        carry = np.zeros_like(grad[0])
        for t in reversed(range(len(data))):
            state, z, r, n, hn = trace[t]
            g = grad[t] + carry
            dn = g * (1 - z) * (1 - n * n)
            dz = 2 * g * (state - n) * z * (1 - z)
            dr = 2 * dn * hn * r * (1 - r)
            dh = np.concatenate([dz, dr, dn * r])
            np.add.at(gx, data[t], np.concatenate([dz, dr, dn]).T)
            gu += dh @ state.T
            carry = g * z + self.u.T @ dh
        gx[PAD] = 0
        return gx.T, gu


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.v = rng.normal(0, 0.1, (len(languages), 2 * hidden)).astype(np.float32)
        self.c = np.zeros((len(languages), 1), np.float32)

    def _read(self, data: np.ndarray, keep: bool = False) -> tuple:
        """Probabilities (time, languages, windows) of every position, and what training needs."""
        fore, ta = self.ahead.forward(data, keep)
        aft, tb = self.back.forward(data[::-1], keep)
        aft = aft[::-1]
        p = self.v[:, : self.hidden] @ fore + self.v[:, self.hidden :] @ aft + self.c
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p, fore, aft, ta, tb

    def train(self, rows: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.015, seed: int = 3) -> None:
        """Fits on rows of bytes; all languages weigh the same."""
        rng = np.random.default_rng(seed)
        weights = 1 / np.bincount(labels, minlength=len(self.languages)).clip(1)[labels]
        params = [self.ahead.x, self.ahead.u, self.back.x, self.back.u, self.v, self.c]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        mean = [np.zeros_like(p) for p in params]  # of the last weights, about a hundred steps
        width = max(map(len, rows))
        data = np.full((len(rows), width), PAD)
        for i, row in enumerate(rows):
            data[i, : len(row)] = np.frombuffer(row, np.uint8)
        order, step, d = np.argsort([len(r) for r in rows], kind="stable"), 0, self.hidden
        steps = epochs * max(1, len(rows) // BATCH)
        for epoch in range(epochs):
            parts = np.array_split(order if epoch else rng.permutation(order), max(1, len(rows) // BATCH))
            for k in rng.permutation(len(parts)):
                own = parts[k]
                batch = data[own].T
                batch = batch[: int((batch != PAD).any(1).sum())]
                p, fore, aft, ta, tb = self._read(batch, keep=True)
                g = p.copy()
                g[:, labels[own], np.arange(len(own))] -= 1
                share = weights[own] * (batch != PAD)
                g *= (share / share.sum()).astype(np.float32)[:, None, :]
                gv = np.concatenate([np.einsum("tlb,tdb->ld", g, s, optimize=True) for s in (fore, aft)], 1)
                ga = self.ahead.backward(batch, ta, self.v[:, :d].T @ g)
                gb = self.back.backward(batch[::-1], tb, (self.v[:, d:].T @ g)[::-1])
                step += 1
                lr = rate * (1 - 0.97 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for q, grad, m1, m2 in zip(params, (*ga, *gb, gv, g.sum((0, 2))[:, None]), first, second, strict=True):
                    m1 += 0.1 * (grad - m1)
                    m2 += 0.001 * (grad * grad - m2)
                    q -= (lr * m1 / (np.sqrt(m2) + 1e-8)).astype(np.float32)
                for q, m in zip(params, mean, strict=True):
                    m += (q - m) * max(1 / step, 0.01)
        for q, m in zip(params, mean, strict=True):
            q[:] = m

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """For each text the sums of its positions' probabilities."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        n = -(-sizes // CORE)
        owner = np.repeat(np.arange(len(texts)), n)
        at = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * CORE  # where a window's core starts in its text
        before, core = np.minimum(at, MARGIN), np.minimum(sizes[owner] - at, CORE)
        after = np.minimum(sizes[owner] - at - core, MARGIN)
        out = np.zeros((len(texts), len(self.languages)))
        order = np.lexsort((core + after, before))  # windows of one batch are of like shape
        for k in range(0, len(order), AT_ONCE):
            own = order[k : k + AT_ONCE]
            left, right = int(before[own].max()), int((core[own] + after[own]).max())
            place = np.arange(-left, right)[:, None]
            real = (place >= -before[own]) & (place < (core + after)[own])
            base = starts[owner[own]] + at[own]
            data = np.where(real, raw[np.where(real, base + place, 0)].astype(np.int64), PAD)
            p = self._read(data)[0] * ((place >= 0) & (place < core[own]))[:, None, :]
            np.add.at(out, owner[own], p.sum(0).T)
        return out


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, str]]:
    """(language, stretch of text) in a fixed order: about per_language stretches of each language."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("length(text) > 0 AND lang IS NOT NULL")
    rows = rows.withColumn("n", F.ceil(F.length("text") / TRAIN_CHARS).cast("int"))
    sizes = rows.groupBy("lang").agg(F.sum("n").alias("n")).collect()  # one row per language
    if not sizes:
        return []
    share = df.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in sizes], "lang string, share double")
    one = F.xxhash64("text")  # copies draw the same stretches, of which one is kept
    drawn = rows.join(F.broadcast(share), "lang").select("lang", "text", one.alias("h"), F.explode(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: _draw(one, i) < F.col("share"))).alias("i"))
    return [(r["lang"], r["t"]) for r in drawn.groupBy("lang", "h", "i").agg(F.min(F.substring("text", F.col("i") * TRAIN_CHARS + 1, F.lit(TRAIN_CHARS))).alias("t")).orderBy("lang", "h", "i").collect()]


def _draw(h: Column, i: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), h, i), F.lit(1 << 30)) / float(1 << 30)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Network | None:
    """Fit on the rows of df that have a language and a text; None if there are none."""
    few = training_rows(df, id_col, text_col, lang_col, rows)
    if not few:
        return None
    languages = sorted({x for x, _ in few})
    network = Network(languages)
    network.train([t.encode("utf-8", "replace") for _, t in few], np.array([languages.index(x) for x, _ in few]))
    return network


def with_language(df: DataFrame, network: Network | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """Adds the two columns of `names`, language and its probability; all columns and rows stay."""
    if network is None:
        return df.withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0)})
    shared = ship(df.sparkSession, network)

    @F.pandas_udf("language string, score double")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = shared.value
        called = np.array([*net.languages, UNKNOWN], object)
        for series in parts:
            texts = series.tolist()
            best, score = np.full(len(texts), len(net.languages)), np.zeros(len(texts))
            for a, b in chunks(texts, CHUNK):
                raw = [t.encode("utf-8", "replace") if t and LETTER.search(t) else b"" for t in texts[a:b]]
                sums = net.sums(raw)
                lettered, total = np.array([bool(t) for t in raw]), sums.sum(1)
                best[a:b] = np.where(lettered, sums.argmax(1), best[a:b])
                score[a:b] = np.where(lettered, np.clip(sums.max(1) / np.maximum(total, 1e-9), 0, 1), 0)
            yield pd.DataFrame({"language": called[best], "score": score})

    found = "__language"
    while found in df.columns:
        found += "_"
    return df.withColumn(found, label(F.col(text_col))).withColumns({names[0]: F.col(f"{found}.language"), names[1]: F.col(f"{found}.score")}).drop(found)
