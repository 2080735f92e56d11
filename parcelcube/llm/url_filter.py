"""URL filter: a trie over reversed host labels and then path segments, broadcast, longest match first.

Rules are (verdict, host, path). A rule fits its host and all subdomains when the url's path starts
with the rule's path. Among fitting rules the longest host wins, then the longest path; for equal
keys a block entry wins over an allow entry. Without a fitting rule the verdict is `default`.

Defined cases: a null url or one without "://" has an empty host and path and gets the default; an
empty table gives an empty result; repeated rows give repeated results; other columns pass through.
A rule with an empty host fits every url. Columns named as the results (host, path, rule, verdict) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelcube.llm.common import ship

#: Rules up to this many characters are broadcast as a trie; longer lists are joined.
BROADCAST_CHARS = 50_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def segments(path: str) -> list[str]:
    """"/en/x" -> ["/", "en/", "x"]; whole segments end in a slash."""
    return re.findall(r"[^/]*/|[^/]+", path)


class Trie:
    """Nodes are dicts: host labels from the last to the first, then path segments."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {"hosts": {}, "paths": None}
        best: dict[tuple[str, str], str] = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict must be allow or block, not {verdict!r}")
            key = (host.translate(str.maketrans(UPPER, LOWER)), path)
            best[key] = "block" if "block" in (verdict, best.get(key)) else "allow"
        for (host, path), verdict in best.items():
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node["hosts"].setdefault(label, {"hosts": {}, "paths": None})
            at = node["paths"] = node["paths"] or {"next": {}, "rules": []}
            *whole, last = segments(path) or [""]
            if last.endswith("/"):
                whole, last = [*whole, last], ""
            for segment in whole:
                at = at["next"].setdefault(segment, {"next": {}, "rules": []})
            at["rules"] = sorted([*at["rules"], (last, host + path, verdict)], key=lambda r: -len(r[0]))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        nodes, node = [], self.root
        if node["paths"]:
            nodes.append(node["paths"])
        for label in reversed(host.split(".")):
            node = node["hosts"].get(label)
            if node is None:
                break
            if node["paths"]:
                nodes.append(node["paths"])
        for at in reversed(nodes):
            trail, rest = [(at, path)], path
            for segment in segments(path):
                at = at["next"].get(segment)
                if at is None:
                    break
                rest = rest[len(segment) :]
                trail.append((at, rest))
            for at, rest in reversed(trail):
                for tail, rule, verdict in at["rules"]:
                    if rest.startswith(tail):
                        return rule, verdict
        return None, None


def _by_trie(df: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    shared = ship(df.sparkSession, Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        trie = shared.value
        found = [trie.match(h, p) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame({"rule": [r for r, _ in found], "verdict": [v or default for _, v in found]})

    return df.withColumn("__found", judge("host", "path")).withColumns({"rule": F.col("__found.rule"), "verdict": F.col("__found.verdict")}).drop("__found")


def _by_join(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For rule lists that outgrow a broadcast: distinct (host, path) meet the rules by host suffix and whole path segments."""
    host, path = F.col("host"), F.col("path")
    labels = F.split(host, r"\.")
    parts = F.split(path, "/")
    keys = (
        df.select("host", "path").distinct()
        .withColumn("__h", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, 999_999), ".")), F.array(F.lit("")))))
        .withColumn("__p", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))))))
    )
    listed = rules.select(
        F.col("verdict").alias("__v"), F.translate("host", UPPER, LOWER).alias("__h"), F.col("path").alias("__path"),
        F.regexp_extract("path", r"^(.*/)?", 0).alias("__p"),
    ).groupBy("__h", "__p", "__path").agg(F.max("__v").alias("__v"))
    best = (
        keys.join(listed, ["__h", "__p"]).where(F.startswith(path, F.col("__path")))
        .groupBy("host", "path").agg(F.max(F.struct(F.length("__h").alias("a"), F.length("__path").alias("b"), F.concat("__h", "__path").alias("rule"), F.col("__v").alias("v"))).alias("__m"))
    )
    out = df.join(best, ["host", "path"], "left")
    return out.withColumns({"rule": F.col("__m.rule"), "verdict": F.coalesce(F.col("__m.v"), F.lit(default))}).drop("__m")


def url_filter(df: DataFrame, rules: list[Rule] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict. rules: a list of (verdict, host, path), or a DataFrame with these columns."""
    df = df.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if isinstance(rules, list):
        if sum(len(h) + len(p) for _, h, p in rules) <= BROADCAST_CHARS:
            return _by_trie(df, rules, default)
        kind = T.StructType([T.StructField(n, T.StringType()) for n in ("verdict", "host", "path")])
        rules = df.sparkSession.createDataFrame(rules, kind)
    size = rules.agg(F.sum(F.length("host") + F.length("path")).alias("n")).first()["n"] or 0
    if size <= BROADCAST_CHARS:
        return _by_trie(df, [(r["verdict"], r["host"], r["path"]) for r in rules.select("verdict", "host", "path").collect()], default)
    return _by_join(df, rules, default)
