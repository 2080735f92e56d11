"""Toxicity from two class-conditional Kneser-Ney models with shared backoff counts.

Each class has its own counts of ORDER-grams of bytes within words (padded at their start, closed at
their end), in which each distinct word of a document counts once, and each text once however many copies it has. Below the highest order both classes share one interpolated
Kneser-Ney model over continuation counts. A gram whose counts in the two classes do not differ decisively (statistic
of the likelihood ratio test under SIGNIFICANT, or estimates less than a factor FACTOR apart) is left to the shared
counts in both, so that rare expressions are equally likely in both and their ratio is one.

A document's signal is the difference of its log-likelihoods under the two models divided by the square root of its length in bytes, the
scale of the noise in a sum of so many terms, and nothing else: divided by the length itself, a few expressions in a long text were lost.
A logistic curve with a slope and a bias turns it into a probability; it is fitted on documents that the model
which scores them hasn't counted (it leaves out their fold).

Counts of the classes come from the whole texts of all labelled documents, and the shared ones from the texts of all
documents. Spark aggregates, tests and joins them; only grams that differ decisively are kept for scoring, and they are
broadcast MOST_GRAMS at a time. The curve is fitted on a sample: about TRAIN_DOCS labelled documents per class, by hash,
weighted by the square roots of the classes' sizes among all labelled texts: between equal weights, which find more, and
natural ones, by which a text without evidence has the share of toxic ones.

Defined cases: a null or empty text scores as a text without evidence; without labels of both classes
every score is the share of toxic labels (0 without labels); repeated rows are scored each; a document
with several labels counts as toxic if one of them is; an empty table gives an empty result; other
columns pass through with_toxicity(), also those named like its own result, which is put beside them under `name`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcube.llm.common import Shipped, WordMemo, by_length, chunks, release, sample_by_class, settle, ship

ORDER, SPAN, DISCOUNT = 6, 24, 0.75
SIGNIFICANT, FACTOR = 16.0, 4.0
TRAIN_DOCS = 3_000
#: Share of either label that no text explains.
LAPSE = 0.05
START, END = 1, 2

#: The curve is fitted on documents of each fold by a model that leaves that fold out.
FOLDS = 5
#: Kind of documents without a label; the others are 2 * fold + toxic.
OTHER = 2 * FOLDS
#: Characters counted at a time in a task.
COUNTED = 1_000_000
#: Labels (an id and a number each) that are broadcast; with more, texts are shuffled to them.
MOST_MARKS = 8_000_000
#: Grams (20 bytes each) that are broadcast at a time; with more, texts are read once for each part of them.
MOST_GRAMS = 4_000_000


def codes(data: np.ndarray) -> np.ndarray:
    """(words, width) bytes -> (words, width + 1) codes of the ORDER-gram that ends at each byte and at the word's end."""
    n, width = data.shape
    padded = np.full((n, ORDER - 1 + width + 1), START, np.uint64)
    padded[:, ORDER - 1 : -1] = data
    padded[:, -1] = END
    out = np.zeros((n, width + 1), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(8)) | padded[:, k : k + width + 1]
    return out


def lower(words: str) -> list[bytes]:
    return words.lower().encode("utf-8", "replace").split()


class Ratios:
    """Log ratios, toxic against ordinary, of the grams that differ decisively; all others have ratio 0."""

    def __init__(self, grams: np.ndarray, ratios: np.ndarray) -> None:
        order = np.argsort(grams)
        self.grams, self.ratios = grams[order].astype(np.uint64), ratios[order].astype(np.float32)

    def score(self, words: list[bytes]) -> np.ndarray:
        """For each word: its log ratio, and its length in bytes, end included."""
        out = np.zeros((len(words), 2), np.float32)
        for owner, data in by_length(words, SPAN):
            code = codes(data)
            total = np.zeros(len(owner), np.float32)
            if len(self.grams):
                at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
                total = np.where(self.grams[at] == code, self.ratios[at], 0).sum(1)
            np.add.at(out, owner, np.column_stack([total, np.full(len(owner), data.shape[1] + 1)]))
        return out


def logistic(x: np.ndarray, y: np.ndarray, toxic_share: float, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and bias of a logistic curve by Newton's method; y weighs as if toxic_share of it were 1.

    A share LAPSE of either label is taken for a matter of chance: in each round a document weighs by how likely its label is
    explained by the curve, so that a few toxic texts without any evidence do not flatten it.
    """
    scale = max(float(np.std(x)), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    weight = np.where(y > 0, toxic_share / max(1, (y > 0).sum()), (1 - toxic_share) / max(1, (y == 0).sum())) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        right = (1 - 2 * LAPSE) * np.where(y > 0, p, 1 - p)
        own = weight * right / (right + LAPSE)
        h = (a * (own * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        w -= np.linalg.solve(h, a.T @ (own * (p - y)) + ridge * w)
    return float(w[0] / scale), float(w[1])


@dataclass
class Scorer:
    """ratios: (part, gram, ratio, ratio_0, ratio_1, ...), of which all but the first leave out a fold; None without labels of both classes."""

    ratios: DataFrame | None
    parts: int
    slope: float = 0.0
    bias: float = 0.0
    prior: float = 0.0

    def part(self, nth: int, column: str) -> Ratios:
        rows = self.ratios.where((F.col("part") == nth) & (F.col(column) != 0)).select("gram", column).toPandas()
        return Ratios(rows["gram"].to_numpy(), rows[column].to_numpy())


def gram_counts(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the words, and how often they occur."""
    n = np.fromiter(words.values(), np.int64, len(words))
    found = [(codes(data), np.repeat(n[owner], data.shape[1] + 1)) for owner, data in by_length(list(words), SPAN)]
    grams, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *[c.ravel() for c, _ in found]]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([np.zeros(0), *[k for _, k in found]]), minlength=len(grams)).astype(np.int64)


def _counted(texts: DataFrame) -> DataFrame:
    """(kind, text) -> (gram, n0, n1, ...): distinct words of documents of each kind that hold a gram; grams of kind OTHER alone have none."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for kind, own in pdf.groupby("kind")["text"]:
                texts = own.tolist()
                for a, b in chunks(texts, COUNTED):
                    words: Counter = Counter()
                    for text in texts[a:b]:
                        words.update(set(lower(text)))
                    grams, n = gram_counts(words)
                    yield pd.DataFrame({"kind": kind, "gram": grams.astype(np.int64), "n": n})

    counted = texts.select("kind", "text").mapInPandas(count, "kind int, gram long, n long")
    return counted.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(OTHER)])


def _head(gram: Column | str) -> Column:
    return F.shiftright(gram, 8)


def _with_shared(wanted: DataFrame, grams: DataFrame) -> DataFrame:
    """Adds base to wanted: what the shared model of lower orders gives for the last byte after those before it.

    Each order is written before the next one is planned: in one plan every order would hold all higher ones, once for each join,
    and the driver would plan and compile them anew after every stage.
    """
    out, level, spent = wanted.withColumns({"base": F.lit(0.0), "weight": F.lit(1.0)}), grams.select("gram"), []
    for order in range(ORDER - 1, 0, -1):
        short = F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1))
        level = settle(level.groupBy(short.alias("gram")).agg(F.count("*").alias("n")))  # distinct left extensions
        heads = level.groupBy(_head("gram").alias("head")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        out = settle(out.withColumns({"code": short, "head": _head(short)}).join(level.withColumnRenamed("gram", "code"), "code").join(heads, "head").withColumns({
            "base": F.col("base") + F.col("weight") * F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total"), "weight": F.col("weight") * DISCOUNT * F.col("kinds") / F.col("total")
        }).drop("code", "head", "n", "total", "kinds"))
        release(*spent)
        spent = [level, out]
    release(level)
    return out.withColumn("base", F.col("base") + F.col("weight") / 256).drop("weight")


def _test(c: list[Column], total: list[Column]) -> Column:
    """Statistic of the likelihood ratio test that a gram is as frequent after its context in both classes."""
    share = (c[0] + c[1]) / (total[0] + total[1])
    term = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    return 2 * sum((term(x, n * share) + term(n - x, n * (1 - share)) for x, n in zip(c, total, strict=True)), F.lit(0.0))


def _ratio(nth: int) -> Column:
    """Log of P(toxic) / P(ordinary), or 0 where the classes do not differ decisively; for the count columns c{nth}_0 and c{nth}_1."""
    logs = []
    for y in (0, 1):
        c, total, kinds = (F.col(f"{name}{nth}_{y}") for name in ("c", "total", "kinds"))
        estimate = (F.greatest(c - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * F.col("base")) / total
        logs.append(F.log(F.when(total > 0, estimate).otherwise(F.col("base"))))
    ratio = logs[1] - logs[0]
    return F.when((F.col(f"test{nth}") >= SIGNIFICANT) & (F.abs(ratio) >= log(FACTOR)), ratio).otherwise(0.0)


def _ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio, ratio_0, ratio_1, ...) of the grams with a ratio other than 0: of all counts, and of those without a fold."""
    views = range(FOLDS + 1)
    total = [sum(F.col(f"n{2 * f + y}") for f in range(FOLDS)) for y in (0, 1)]
    own = {f"c{v}_{y}": total[y] - F.col(f"n{2 * (v - 1) + y}") if v else total[y] for v in views for y in (0, 1)}
    counts = grams.select("gram", _head("gram").alias("head"), *[c.alias(name) for name, c in own.items()])
    heads = counts.groupBy("head").agg(*[F.sum(c).alias(c.replace("c", "total")) for c in own], *[F.count_if(F.col(c) > 0).alias(c.replace("c", "kinds")) for c in own])
    tested = counts.where("c0_0 + c0_1 > 0").join(heads, "head").drop("head")
    for v in views:
        n = [F.col(f"total{v}_{y}") for y in (0, 1)]
        tested = tested.withColumn(f"test{v}", F.when((n[0] > 0) & (n[1] > 0), _test([F.col(f"c{v}_{y}") for y in (0, 1)], n)).otherwise(0.0))
    decisive = settle(tested.where(F.greatest(*[f"test{v}" for v in views]) >= SIGNIFICANT))
    names = ["ratio", *[f"ratio_{f}" for f in range(FOLDS)]]
    out = _with_shared(decisive, grams).select("gram", *[_ratio(v).alias(name) for v, name in enumerate(names)])
    return out.where(" OR ".join(f"{name} != 0" for name in names))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_DOCS) -> Scorer:
    """docs: texts by id; labels: the labelled ids that may be learnt from."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IS NOT NULL AND id IS NOT NULL").groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    marks = F.broadcast(known) if known.count() <= MOST_MARKS else known
    same = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("again"), "text").alias("h2")]
    chosen = settle(texts.join(marks, "id").select("id", "toxic", *same).groupBy("h1", "h2", "toxic").agg(F.min("id").alias("id")).select("id", "toxic"))  # each text once
    shown = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(shown) < 2:
        return Scorer(None, 0, prior=float(1 in shown))
    fold = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(FOLDS)).cast("int")
    marks = F.broadcast(chosen) if sum(shown.values()) <= MOST_MARKS else chosen
    kind = F.coalesce(2 * fold + F.col("toxic"), F.lit(OTHER)).alias("kind")
    grams = settle(_counted(texts.join(marks, "id", "left").select(kind, "text")))
    ratios = settle(_ratios(grams))
    parts = max(1, -(-ratios.count() // MOST_GRAMS))
    scorer = Scorer(ratios.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int")), parts)
    few = sample_by_class(chosen, "toxic", "id", per_class)
    sample = settle(texts.join(F.broadcast(few), "id").select("id", "text", "toxic", fold.alias("fold")))
    seen = None
    for nth in range(parts):
        folds = ship(spark, [scorer.part(nth, f"ratio_{f}") for f in range(FOLDS)])

        def describe(rows: Iterator[pd.DataFrame], folds=folds) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            memos = [WordMemo(m.score, 2) for m in folds.value]
            for pdf in rows:
                for f, own in pdf.groupby("fold"):
                    texts = own["text"].tolist()
                    for a, b in chunks(texts):
                        sums = memos[f].sums([lower(t) for t in texts[a:b]])
                        yield pd.DataFrame({"id": own["id"].to_numpy()[a:b], "toxic": own["toxic"].to_numpy()[a:b], "x": sums[:, 0] / np.sqrt(np.maximum(sums[:, 1], 1))})

        kind = sample.schema["id"].dataType.simpleString()
        found = sample.select("id", "toxic", "fold", "text").mapInPandas(describe, f"id {kind}, toxic int, x double").toPandas().sort_values(["id", "x"])
        folds.unpersist()
        seen = found if seen is None else seen.assign(x=seen["x"].to_numpy() + found["x"].to_numpy())
    scorer.slope, scorer.bias = logistic(seen["x"].to_numpy(), seen["toxic"].to_numpy(float), shown[1] ** 0.5 / (shown[0] ** 0.5 + shown[1] ** 0.5))
    return scorer


def _mean(ratios: Shipped) -> Callable:
    """The log ratio of a text by the square root of its bytes, as far as the grams of ratios go."""

    @F.pandas_udf("double")
    def mean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = WordMemo(ratios.value.score, 2)
        for series in parts:
            texts, out = series.tolist(), np.zeros(len(series))
            for a, b in chunks(texts):
                sums = memo.sums([lower(t) if t else [] for t in texts[a:b]])
                out[a:b] = sums[:, 0] / np.sqrt(np.maximum(sums[:, 1], 1))
            yield pd.Series(out)

    return mean


def with_toxicity(df: DataFrame, scorer: Scorer, text_col: str = "text", name: str = "toxic_score") -> DataFrame:
    """Adds a column `name` with the score; all other columns and rows stay."""
    if scorer.ratios is None:
        return df.withColumn(name, F.lit(scorer.prior))
    for nth in range(scorer.parts):
        mean = _mean(ship(df.sparkSession, scorer.part(nth, "ratio")))(F.col(text_col))
        df = df.withColumn(name, mean if nth == 0 else F.col(name) + mean)
        if scorer.parts > 1:  # the grams of one part are in memory at a time
            df = settle(df)
    exponent = scorer.slope * F.col(name) + scorer.bias
    return df.withColumn(name, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), exponent)))))
