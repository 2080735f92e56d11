"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelcube.llm import language_id, toxicity
from parcelcube.llm.alignment import align, scores
from parcelcube.llm.ann import nearest
from parcelcube.llm.common import fold, table
from parcelcube.llm.decontaminate import leaks
from parcelcube.llm.licenses import license_summary
from parcelcube.llm.minhash import near_duplicates
from parcelcube.llm.packing import pack_documents
from parcelcube.llm.periodic_runs import periodic_runs
from parcelcube.llm.quality import LEAST_WORDS, MOST_REPEATED, RULES, STOP_WORDS, WORD, let, quality
from parcelcube.llm.sharding import shard_by_size
from parcelcube.llm.token_counts import token_counts
from parcelcube.llm.url_filter import url_filter

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language_id.train(docs.where(fold("doc_id", 3) != 1))
    held_out = fold("doc_id", 3) == 1
    return language_id.with_language(docs.select("doc_id", "text"), network).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    held_out = fold("doc_id", 5) == 0
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), scorer)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_size(table(spark, sf_dir, "documents"), shards=40)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_summary(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    found = scores(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def with_cycles(doc_id: Column, text: Column) -> Column:
    """The text in which, for a tenth of all ids, every word from the a-th on is one of the p words from there, again and again."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def cycled(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.when((h % 10 == 0) & (n > 0), F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(words[a + F.pmod(i - a, p)])), " ")).otherwise(text)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), cycled)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs, text=with_cycles(F.col("doc_id"), F.col("text")))
    # exact order of length / period: the difference of cross products
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT k.b, r.c FROM reach r JOIN both_ways k ON k.a = r.id),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN least ON least.id = n.doc_id
"""

OP8_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS gram FROM w),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
cover AS (SELECT r, sum(least(5, nxt - i)) AS n FROM (SELECT r, i, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), i + 5) AS nxt FROM again) GROUP BY r),
c AS (
  SELECT doc_id, len(ws) AS n_words, length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars, length(x) - length(translate(x, '#*$%&|<>', '')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(ws, lambda v: list_contains([STOPS], v))) AS n_stop_words, length(regexp_replace(x, '\P{L}+', '', 'g')) AS n_letters,
         len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines, len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines
  FROM w LEFT JOIN cover USING (r)),
f AS (SELECT *, n_words < LEAST_WORDS OR 100 * n_repeat_words > MOST_REPEATED * n_words AS base_failed, list_filter([RULES], lambda v: v IS NOT NULL) AS failed_rules FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, array_to_string(failed_rules, ',') AS failed_rules, NOT base_failed AND len(failed_rules) = 0 AS kept FROM f
"""


def op13_sql() -> str:
    """The thresholds of the table as SQL."""
    stops = ", ".join(f"'{form}'" for w in STOP_WORDS for form in (w, w.capitalize(), w.upper()))
    rules = ", ".join(f"CASE WHEN 1000 * {r.count} < {r.least} * {r.per} OR 1000 * {r.count} > {r.most} * {r.per} THEN '{r.name}' END" for r in RULES)
    return OP13_SQL.replace("STOPS", stops).replace("RULES", rules).replace("LEAST_WORDS", str(LEAST_WORDS)).replace("MOST_REPEATED", str(MOST_REPEATED))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_ann, op4_near_dedup, op5_decontaminate, op6_token_counts, op7_packing, op8_url_filter, op9_sharding, op10_license_scan, op11_alignment, op12_periodic_runs, op13_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": OP4_SQL, "op8_url_filter": OP8_SQL, "op13_quality": op13_sql()}
