"""Approximate nearest neighbours by inner product: inverted lists scanned by adaptive dimension sampling.

Vectors get one more component that makes all norms equal, so the largest inner product is the least
distance, and are turned by one random rotation, so any block of components is a fair sample of a
distance: the share of it in m of d components is distributed as Beta(m/2, (d-m)/2). Centroids are
fitted on about TRAIN_ROWS vectors, and the number of lists to probe is the least that finds RECALL of the
neighbours of ASKED of these vectors among them. Every vector is put in its list.

A query first scans its nearest lists, until they hold enough vectors, and so has a bound: the distance
of its (k + 1)-th best. With that bound it scans its other lists, and the bound goes on from list to list. In a list
components are read block by block; after each block a candidate is abandoned if its partial distance
would be so large for a candidate within the bound only with probability ALPHA. Those that remain are
scored in double precision on the original vectors.

Equal vectors are one candidate that carries its k + 1 least ids, which is all that ties can need, and equal query
vectors are searched once. Small lists share a group, large ones are cut by a hash of their rows, and the queries of a
group are cut too, so that a task meets about UNIT_ROWS x UNIT_QUERIES at most, whatever list or vector is hot.
Results go back to the copies of a query vector salted: a vector asked for by more than one in
HOT_PARTS queries is one of HOT_PARTS at most, so a table of these is small enough to broadcast.

Defined cases: vectors that are null, zero, or that hold null or non-finite components take no part, neither as query
nor as candidate; vectors of different lengths are searched apart, each among those of its length; fewer than k
candidates are all returned; ties go to the smaller id; null ids take no part; rows that repeat an id and vector are one
candidate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelcube.llm.common import hash_share, settle, ship

TRAIN_ROWS, ROUNDS, MOST_LISTS = 20_000, 8, 2_048
ASKED, RECALL = 256, 0.96
UNIT_ROWS, UNIT_QUERIES, BLOCK, ALPHA = 2_048, 4_096, 8, 0.004
#: The nearest lists that give the first bound hold so many times as many vectors as are sought.
FIRST = 16
#: Squared distances of vectors scaled to at most unit length that differ less are decided by the exact scores.
TIE = 1e-9
#: Pairs of a list and queries whose partial distances are held at once.
PAIRS = 2_000_000
#: A query vector with more than one in HOT_PARTS of all queries is dealt over several tasks.
HOT_PARTS = 1_000


def _usable(vec: Column) -> Column:
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(vec, lambda x: x != 0)


def beta_quantile(a: float, b: float, p: float) -> float:
    """Quantile of the beta distribution, by summing its density over a fine grid."""
    x = (np.arange(200_000) + 0.5) / 200_000
    log = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    mass = np.exp(log - log.max()).cumsum()
    return float(x[min(np.searchsorted(mass, p * mass[-1]), len(x) - 1)])


class Index:
    """Rotation, centroids, the limits of the tests, and the transforms of rows and queries."""

    def __init__(self, sample: np.ndarray, norm: float, lists: int, k: int = 20, seed: int = 7) -> None:
        """norm: the largest one of all vectors; they are scaled by it."""
        rng = np.random.default_rng(seed)
        self.norm, d = norm, sample.shape[1] + 1
        turn, r = np.linalg.qr(rng.normal(size=(d, d)))
        self.turn = turn * np.sign(np.diag(r))
        self.cuts = [*range(0, d, BLOCK), d]
        self.limits = [beta_quantile(m / 2, (d - m) / 2, 1 - ALPHA) for m in self.cuts[1:-1]] + [1.0]
        x = self.rows(sample)
        c = x[rng.permutation(len(x))[:lists]]
        for _ in range(ROUNDS):
            near = self._nearest(x, c)
            n = np.bincount(near, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        main = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0]
        self.centroids = c[np.argsort(c @ main, kind="stable")]  # lists of one group lie near each other
        self.probes = self._calibrated(sample, x, k, rng)

    def _calibrated(self, sample: np.ndarray, x: np.ndarray, k: int, rng: np.random.Generator) -> int:
        """Lists to probe for RECALL of the k nearest, over all neighbours of ASKED vectors of the sample."""
        if len(x) <= k + 1:
            return len(self.centroids)
        asked = rng.permutation(len(x))[:ASKED]
        score = (sample[asked] / self.norm) @ (sample / self.norm).T
        score[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        place = np.argsort(self._order(self.queries(sample[asked])), axis=1)
        needed = np.sort(np.take_along_axis(place, self._nearest(x, self.centroids)[best], axis=1).ravel()) + 1
        return int(needed[int(np.ceil(RECALL * len(needed))) - 1])

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        half = (c * c).sum(1) / 2
        return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)

    def _order(self, turned: np.ndarray) -> np.ndarray:
        c = self.centroids
        return np.argsort((c * c).sum(1) / 2 - turned @ c.T, axis=1, kind="stable")

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        rest = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
        return np.column_stack([x, rest]) @ self.turn

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q / self.norm) @ self.turn[:-1]

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(self.rows(x), self.centroids)

    def probed(self, q: np.ndarray, members: np.ndarray, enough: int, first: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the nearest lists, until they hold `first` vectors, and then the others up to `probes`, or more until `enough`."""
        order = self._order(self.queries(q))
        held = members[order].cumsum(1)
        out = []
        for lists, h in zip(order, held, strict=True):
            most = max(self.probes, int(np.searchsorted(h, enough)) + 1)
            cut = min(most, int(np.searchsorted(h, first)) + 1)
            out.append((lists[:cut], lists[cut:most]))
        return out


class Scan:
    """Scans the lists of a unit for its queries; `read` of `all` components were looked at."""

    def __init__(self, index: Index, x: np.ndarray, lists: np.ndarray, k: int) -> None:
        order = np.argsort(lists, kind="stable")
        self.index, self.x, self.k = index, x, k
        turned = index.rows(x)
        self.parts = {}
        names, starts = np.unique(lists[order], return_index=True)
        for name, rows in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
            blocks = [np.ascontiguousarray(turned[rows, a:b]) for a, b in zip(index.cuts[:-1], index.cuts[1:], strict=True)]
            self.parts[name] = rows, blocks, [(c * c).sum(1) for c in blocks]
        self.read = self.all = 0

    def list(self, name: int, turned: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the pairs of one list that no test abandons."""
        rows, blocks, squares = self.parts[name]
        wide, n = len(rows), len(turned)
        cuts = self.index.cuts
        self.all += n * wide * cuts[-1]
        at_q = at_r = None
        partial = np.zeros((n, wide))
        for nth, (block, square) in enumerate(zip(blocks, squares, strict=True)):
            own = turned[:, cuts[nth] : cuts[nth + 1]]
            if at_q is None:  # most pairs are still in: one matrix product
                self.read += partial.size * block.shape[1]
                partial += square - 2 * (own @ block.T) + (own * own).sum(1)[:, None]
                stay = partial <= (bound * self.index.limits[nth])[:, None] * (1 + 1e-12)
                if 3 * np.count_nonzero(stay) < 2 * stay.size or nth == len(blocks) - 1:
                    at_q, at_r = np.nonzero(stay)
                    partial = partial[at_q, at_r]
            else:
                self.read += len(at_q) * block.shape[1]
                gap = own[at_q] - block[at_r]
                partial = partial + np.einsum("ij,ij->i", gap, gap)
                stay = partial <= bound[at_q] * self.index.limits[nth] * (1 + 1e-12)
                at_q, at_r, partial = at_q[stay], at_r[stay], partial[stay]
        return at_q, rows[at_r], partial

    def best(self, q: np.ndarray, probes: list[np.ndarray], bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance): for each query at least its k nearest within the bound; more where distances tie."""
        turned, bound = self.index.queries(q), bound.copy()
        asks = np.concatenate([np.zeros(0, int), *probes]).astype(int)
        owner = np.repeat(np.arange(len(q)), [len(p) for p in probes])
        found = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for name in sorted(set(asks.tolist()) & set(self.parts)):
            who = owner[asks == name]
            step = max(1, PAIRS // len(self.parts[name][0]))
            for a in range(0, len(who), step):
                own = who[a : a + step]
                near, row, distance = self.list(name, turned[own], bound[own])
                found = tuple(np.concatenate([old, new]) for old, new in zip(found, (own[near], row, distance), strict=True))
            found = self._cut(found, bound)
        return found

    def _cut(self, found: tuple[np.ndarray, np.ndarray, np.ndarray], bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drops what is not among a query's k nearest so far, and lowers the bounds."""
        order = np.lexsort((found[2], found[0]))
        q, row, distance = (x[order] for x in found)
        starts = np.searchsorted(q, np.arange(len(bound) + 1))
        full = np.flatnonzero(np.diff(starts) >= self.k)
        bound[full] = np.minimum(bound[full], distance[starts[full] + self.k - 1] + TIE)
        stay = distance <= bound[q]
        return q[stay], row[stay], distance[stay]


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Returns query_id, rank, id_col, score: the k rows nearest to each query row, itself excluded."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("asks")).where(F.col("id").isNotNull() & _usable(F.col("vec")))
    sizes = [r["d"] for r in rows.select(F.size("vec").alias("d")).distinct().orderBy("d").collect()]  # one row per length of vectors
    if not sizes:
        return df.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    found = [_nearest(rows.where(F.size("vec") == d), k) for d in sizes]
    return reduce(DataFrame.union, found).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) of usable rows (id, vec, asks) of one length."""
    spark = rows.sparkSession
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("again"), "vec")})
    ids = rows.select("h1", "h2", "id", "vec").withColumn("nth", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("nth") <= k + 1)
    classes = settle(ids.groupBy("h1", "h2").agg(F.min("id").alias("cid"), F.sort_array(F.collect_set("id")).alias("ids"), F.first("vec").alias("vec")))
    asked = rows.where("asks").select("h1", "h2", F.col("id").alias("query_id")).distinct()
    counts = asked.groupBy("h1", "h2").agg(F.count("*").alias("asks"))
    questions = settle(classes.join(counts, ["h1", "h2"]).select("h1", "h2", F.col("cid").alias("qid"), F.col("vec").alias("q"), "asks"))

    norm = F.aggregate("vec", F.lit(0.0), F.hypot)  # large components do not overflow
    facts = classes.agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first()
    sample = classes.where(hash_share("cid", 5) < TRAIN_ROWS / max(1, facts["n"])).select("cid", "vec").toPandas().sort_values("cid")["vec"].tolist() or [r["vec"] for r in classes.orderBy("cid").select("vec").limit(1).collect()]
    lists = max(1, min(MOST_LISTS, round(facts["n"] ** 0.5), -(-len(sample) // 8)))
    index = Index(np.array(sample, float), facts["norm"], lists, k)
    shared = ship(spark, index)

    @F.pandas_udf("int")
    def assign(vec: pd.Series) -> pd.Series:
        return pd.Series(shared.value.lists_of(np.array(vec.tolist(), float).reshape(len(vec), -1)))

    stored = settle(classes.select("cid", "ids", "vec", assign("vec").alias("list")))
    held = {r["list"]: (r["n"], r["m"]) for r in stored.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("m")).collect()}  # at most MOST_LISTS rows
    rows_in, members = (np.array([held.get(i, (0, 0))[j] for i in range(lists)]) for j in (0, 1))
    group_of = (rows_in.cumsum() - rows_in) // UNIT_ROWS  # neighbouring lists of UNIT_ROWS vectors in all
    last = np.append(group_of[1:] != group_of[:-1], True)
    group_of = np.concatenate([[0], last.cumsum()[:-1]])  # numbered without gaps, at most MOST_LISTS
    sizes = np.bincount(group_of, weights=rows_in).astype(int)

    @F.pandas_udf("array<struct<first:boolean,group:int,lists:array<int>>>")
    def probe(vec: pd.Series) -> pd.Series:
        out = []
        for parts in shared.value.probed(np.array(vec.tolist(), float).reshape(len(vec), -1), members, k + 1, FIRST * (k + 1)):
            own = []
            for first, chosen in zip((True, False), parts, strict=True):
                if not len(chosen):
                    continue
                chosen = np.sort(chosen)
                names, starts = np.unique(group_of[chosen], return_index=True)
                own += [{"first": first, "group": int(g), "lists": p.tolist()} for g, p in zip(names, np.split(chosen, starts[1:]), strict=True)]
            out.append(own)
        return pd.Series(out)

    asking = settle(questions.select("qid", "q", F.explode(probe("q")).alias("p")).select("qid", "q", "p.*"))
    wanted = {(r["first"], r["group"]): r["n"] for r in asking.groupBy("first", "group").agg(F.count("*").alias("n")).collect()}  # two rows a group at most
    named = settle(stored.join(F.broadcast(spark.createDataFrame([(i, int(g)) for i, g in enumerate(group_of)], "list int, group int")), "list").select("cid", "vec", "list", "group"))

    def wave(first: bool, asks: DataFrame) -> DataFrame:
        """(qid, cid, score, distance) of what the units of asks (qid, q, group, lists, bound) find."""
        cut = spark.createDataFrame([(g, -(-int(n) // UNIT_ROWS), -(-wanted[first, g] // UNIT_QUERIES)) for g, n in enumerate(sizes) if n and (first, g) in wanted], "group int, row_cuts int, query_cuts int")
        row_cut, query_cut = (F.pmod(F.xxhash64(c), F.col(n)).cast("int") for c, n in (("cid", "row_cuts"), ("qid", "query_cuts")))
        left = asks.join(F.broadcast(cut), "group").select("group", query_cut.alias("b"), F.explode(F.sequence(F.lit(0), F.col("row_cuts") - 1)).alias("a"), "qid", "q", "lists", "bound")
        right = named.join(F.broadcast(cut), "group").select("group", row_cut.alias("a"), F.explode(F.sequence(F.lit(0), F.col("query_cuts") - 1)).alias("b"), "cid", "vec", "list")

        def unit(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(asking) or not len(held):
                return pd.DataFrame({"qid": [], "cid": [], "score": [], "distance": []})
            asking, held = asking.sort_values("qid"), held.sort_values("cid")
            x, q, cids = np.array(held["vec"].tolist(), float), np.array(asking["q"].tolist(), float), held["cid"].to_numpy()
            bound = asking["bound"].fillna(np.inf).to_numpy(float)
            who, row, distance = Scan(shared.value, x, held["list"].to_numpy(), k + 1).best(q, [np.asarray(p) for p in asking["lists"]], bound)
            return pd.DataFrame({"qid": asking["qid"].to_numpy()[who], "cid": cids[row], "score": np.einsum("ij,ij->i", q[who], x[row]), "distance": distance})

        keys = ["group", "a", "b"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(unit, "qid long, cid long, score double, distance double")
        return _top(found, k + 1)

    near = settle(wave(True, asking.where("first").withColumn("bound", F.lit(None).cast("double"))))
    bounds = near.groupBy("qid").agg(F.when(F.count("*") > k, F.max("distance")).alias("bound"))
    rest = asking.where("NOT first").join(bounds, "qid", "left").withColumn("bound", F.col("bound") + TIE)
    best = settle(_top(near.unionByName(wave(False, rest)), k + 1))
    answers = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "score")))
    listed = best.join(stored.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("id")).groupBy("qid").agg(F.slice(answers, 1, k + 1).alias("found"))
    return _answered(asked, questions.drop("q").join(listed, "qid"), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def _answered(asked: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """Every copy (h1, h2, query_id) of a query vector gets its vector's answers but itself; copies of hot vectors are dealt over several tasks."""
    total = answers.agg(F.sum("asks").alias("n")).first()["n"] or 0
    share = max(1, -(-total // HOT_PARTS))
    salts = F.ceil(F.col("asks") / share).cast("int")
    hot = answers.where(F.col("asks") > share).select("h1", "h2", salts.alias("salts"))  # at most HOT_PARTS rows
    dealt = asked.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("h1", "h2", "salt", "found")
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return dealt.join(copies, ["h1", "h2", "salt"]).select("query_id", F.posexplode(own).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
