"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, components.

1. Each text becomes its set of k-word shingles, a 128-bit identity of the set, its signature and one
   key per band. Equal sets are one class from here on, with a number of its own.
2. Classes that share a band key are candidates. Each bucket compares all members with a pivot,
   the most connected one. Members that the links so far leave outside the bucket's largest component
   are first compared with leading holders of what they have beyond the pivot; those still outside
   are then compared with the members of other components that share an item the pivot lacks, or whose
   intersections with the pivot are large enough without one. So every pair of a bucket is compared,
   linked already or ruled out by an exact bound. No bucket is collected, capped or sampled.
3. A candidate pair is a link if 100 * |A and B| >= percent * |A or B| on the full sets.
4. Components of the links by alternating stars, the union-find that many machines can share, named by their least id.

Members of a hot bucket and comparisons with a hot pivot are dealt over several tasks.

With BANDS = 42 bands of 6 values a pair at the threshold of 0.8 is missed with probability 3e-6.

Defined cases: a null text or one without words has an empty set, is its own component and is kept; fewer
than k words form one shingle; rows that share an id are judged each by its own text, and repeated rows appear each; a row with
a null id is linked like any other, but gives its component no name: a component of such rows alone is null, and they are
kept; an empty table gives an empty result; other columns are ignored. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcube.llm.common import chunks, release, salted_join, settle
from parcelcube.llm.components import connected_components, joined
from parcelcube.llm.shingles import band_keys, mix, shingle_hashes, super_minhash

BANDS, ROWS = 42, 6
#: Bytes of text hashed at a time; the arrays in between take about fifty times as much.
HASH_BYTES = 500_000


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def signature(text: Column, k: int, bands: int = BANDS, rows: int = ROWS) -> Column:
    """Struct of n (set size), h1, h2 (identity of the set), keys (one per band; empty for an empty set)."""

    @F.pandas_udf("n long, h1 long, h2 long, keys array<long>")
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in parts:
            texts, out = [_bytes(t) for t in series], []
            for a, b in chunks(texts, HASH_BYTES):
                sets, bounds = shingle_hashes(texts[a:b], k)
                n = np.diff(bounds)
                with np.errstate(over="ignore"):
                    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
                    h1, h2 = (mix(t[bounds[1:]] - t[bounds[:-1]] + n.astype(np.uint64)).view(np.int64) for t in total)
                keys = band_keys(super_minhash(sets, bounds, bands * rows), bands)
                out.append(pd.DataFrame({"n": n, "h1": h1, "h2": h2, "keys": [x if m else x[:0] for x, m in zip(keys, n, strict=True)]}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"n": [], "h1": [], "h2": [], "keys": []})

    return sign(text)


def shingle_set(text: Column, k: int) -> Column:
    """The sorted distinct shingle hashes."""

    @F.pandas_udf("array<long>")
    def collect(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in parts:
            texts, out = [_bytes(t) for t in series], []
            for a, b in chunks(texts, HASH_BYTES):
                sets, bounds = shingle_hashes(texts[a:b], k)
                sets = sets.view(np.int64)
                out += [sets[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pd.Series(out, dtype=object)

    return collect(text)


def _compare(pairs: DataFrame, sets: DataFrame, rest: bool = False) -> DataFrame:
    """(a, b) -> (a, b, na, nb, common): set sizes and the size of the intersection; rest: also what only a has. A b that is in many pairs is dealt over several tasks."""
    pairs = settle(pairs)
    near = salted_join(pairs, sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b", "a").join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    extra = [F.array_except("x", "y").alias("rest")] if rest else []
    return near.select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("common"), *extra)


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _stars(buckets: DataFrame) -> DataFrame:
    """Every member of a bucket (key, id, n) with the bucket's pivot: the member that is in the most and largest buckets."""
    weights = buckets.groupBy("id").agg(F.sum("members").alias("weight"))
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("id")))
    pivots = buckets.join(weights, "id").groupBy("key").agg(best["id"].alias("pivot"))
    return salted_join(buckets, pivots, "key", "id").select("key", "id", "n", "pivot")


def _apart(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (key, id, n, pivot, common) of buckets with several components, labelled, and those outside the largest one."""
    named = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    kinds = named.groupBy("key", "label").agg(F.count("*").alias("size")).groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("size", F.col("label").alias("most")))["most"].alias("most"))
    mixed = settle(named.join(kinds.where("kinds > 1").drop("kinds"), "key"))
    return mixed.drop("most"), mixed.where("label != most").select("key", "pivot", F.col("id").alias("v"), F.col("n").alias("vn"), F.col("common").alias("vc"), F.col("label").alias("vl"))


def _marks(scored: DataFrame, apart: DataFrame) -> DataFrame:
    """(pivot, id, mark): what members hold beyond their pivot. Items that the same members hold say the same and make one mark; those of a single member make none."""
    rest = scored.select(F.col("a").alias("id"), F.col("b").alias("pivot"), F.explode("rest").alias("item")).join(apart.select("pivot").distinct(), "pivot", "left_semi")
    holders = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"h{k}") for k in (1, 2)]
    kinds = rest.groupBy("pivot", "item").agg(F.count("*").alias("n"), F.struct(*holders).alias("mark")).where("n > 1")
    return rest.join(kinds, ["pivot", "item"]).select("pivot", "id", "mark").distinct()


def _of_marks(marks: DataFrame, apart: DataFrame) -> DataFrame:
    return apart.select("pivot", F.col("v").alias("id"), "vl", "vn", "vc").distinct().join(marks, ["id", "pivot"]).select("pivot", "mark", F.col("id").alias("v"), "vl", "vn", "vc")


def _leading(members: DataFrame, apart: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs (a, b) of members apart with the member nearest to the pivot among the holders of each of their marks."""
    near = F.max(F.struct("common", (-F.col("id")).alias("i")))
    leads = members.select("pivot", "id", "common").distinct().join(marks, ["id", "pivot"]).groupBy("pivot", "mark").agg((-near["i"]).alias("id"))
    return leads.join(_of_marks(marks, apart), ["pivot", "mark"]).where("id != v").select(*_ordered("id", "v")).distinct()


def _bands(size: str, percent: int) -> Column:
    """Sizes of which the smaller is at least percent of the larger are in one band or in neighbouring ones."""
    return F.floor(F.log(F.col(size).cast("double")) / math.log(max(100 / percent, 1.01))).cast("int")


def _near(size: str, percent: int) -> Column:
    return F.explode(F.sequence(_bands(size, percent) - 1, _bands(size, percent) + 1)).alias("band")


def _possible(members: DataFrame, apart: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components, one of them apart, that may be links.

    Two members that share nothing beyond their pivot have at most the smaller of their intersections with
    it in common. That bound needs both to lie in the pivot for percent of their size at least, with intersections of like
    size, which only few members of a bucket have that are not linked through the pivot already. All others share a mark, and are of like size.
    """
    most = F.least("common", "vc")
    inside = members.where(100 * F.col("common") >= percent * F.col("n")).where("common > 0").withColumn("band", _bands("common", percent))
    outer = apart.drop("pivot").where(100 * F.col("vc") >= percent * F.col("vn")).where("vc > 0").select("*", _near("vc", percent))
    bound = inside.join(outer, ["key", "band"]).where((F.col("label") != F.col("vl")) & (100 * most >= percent * (F.col("n") + F.col("vn") - most))).select(*_ordered("id", "v"))
    of_members = members.select("pivot", "id", "label", "n", "common").distinct().join(marks, ["id", "pivot"]).withColumn("band", _bands("n", percent))
    both = most + F.least(F.col("n") - F.col("common"), F.col("vn") - F.col("vc"))  # the parts within and beyond the pivot
    of_apart = _of_marks(marks, apart).select("*", _near("vn", percent))
    shared = of_members.join(of_apart, ["pivot", "mark", "band"]).where((F.col("label") != F.col("vl")) & (100 * both >= percent * (F.col("n") + F.col("vn") - both))).select(*_ordered("id", "v"))
    return bound.union(shared).distinct()


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_shingles, component_id, kept. Ids are integers."""
    if not 0 < percent <= 100 or k < 1:
        raise ValueError("percent must be in 1..100 and k positive")
    text = F.col("text")
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit("again"), text)})
    signed = settle(docs.withColumn("s", signature(text, k)).select("doc", "t1", "t2", "s.*"))
    kinds = signed.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("doc", "t1", "t2")).alias("of"), F.min("doc").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = settle(kinds.withColumn("id", F.monotonically_increasing_id()))  # written once, so the numbers stay
    keyed = classes.select(F.explode("keys").alias("key"), "id", "n")
    counts = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = settle(keyed.join(counts, "key"))
    candidates = classes.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "of.*")
    same = docs["doc"].eqNullSafe(candidates["doc"]) & (docs["t1"] == candidates["t1"]) & (docs["t2"] == candidates["t2"])
    texts = docs.join(candidates, same).select("id", docs["text"]).groupBy("id").agg(F.min("text").alias("text"))  # rows that repeat a document give one
    sets = settle(texts.select("id", shingle_set(text, k).alias("items")))
    stars = settle(_stars(buckets))
    scored = settle(_compare(stars.where("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), sets, rest=True))
    linked = 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))
    labels = connected_components(scored.where(linked).select(*_ordered("a", "b")))
    with_pivot = scored.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "common")
    members = stars.join(with_pivot, ["id", "pivot"], "left").withColumn("common", F.coalesce("common", "n"))
    release(buckets)
    members, apart = _apart(members, labels)
    marks = settle(_marks(scored, apart))
    found = settle(_compare(_leading(members, apart, marks), sets).where(linked).select("a", "b"))
    if not found.isEmpty():
        labels = joined(labels, found)
        members, apart = _apart(members.drop("label"), labels)
    found = settle(_compare(_possible(members, apart, marks, percent), sets).where(linked).select("a", "b"))
    if not found.isEmpty():
        labels = joined(labels, found)
    named = classes.select("h1", "h2", "id", "least").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    reached = named.groupBy("label").agg(F.min("least").alias("component"))
    named = named.join(reached, "label").select("h1", "h2", "component")
    out = signed.select("doc", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))
