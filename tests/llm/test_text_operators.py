"""Token counts, packing, language, toxicity, licences, sharding and url filter on small fixtures."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parcelcube.llm import language_id, licenses, queries, toxicity
from parcelcube.llm import sharding as SH
from parcelcube.llm import url_filter as U
from parcelcube.llm.alignment import Aligner, align, byte_of_symbol, scores
from parcelcube.llm.common import WordMemo, by_length
from parcelcube.llm.packing import Encoder, pack_documents, plan_sequences
from parcelcube.llm.periodic_runs import find_runs, periodic_runs
from parcelcube.llm.quality import quality
from parcelcube.llm.token_counts import token_counts
from tests.llm.conftest import SF
from tests.oracle import connect, rows_of_spark, rows_of_sql

PIECES, WORDS, BYTES = map(public_tokenizers.path, ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))


def test_words_by_length_and_memo_with_any_limit():
    words = [b"", b"a", b"abc" * 20, b"xyz", b"ab"]
    out = defaultdict(bytes)
    for owner, data in by_length(words, 24):
        for o, row in zip(owner, data, strict=True):
            out[o] += row.tobytes()
    assert [len(out[i]) for i in range(5)] == [0, 1, 60, 3, 2]
    docs = [[b"a", b"b", b"a"], [], [b"c"]]
    for limit in (0, 100):
        memo = WordMemo(lambda ws: np.array([[w[0]] for w in ws], float), 1, limit, float)
        for _ in range(3):
            assert memo.sums(docs)[:, 0].tolist() == [97 + 98 + 97, 0, 99]


def test_token_counts_equal_the_library(odd_documents, empty_documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts(odd_documents, PIECES, limit=50).collect()
    texts = defaultdict(list)
    for r in odd_documents.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    for r in got:
        text = texts[r["doc_id"]][0]
        assert r["n_tokens"] == len(lib.encode(text)) and r["n_bytes"] == len(text.encode()) and r["over_limit"] == (r["n_tokens"] > 50)
    assert len(got) == 12 and token_counts(empty_documents, PIECES).count() == 0


def test_token_counts_on_random_texts(spark):
    import sentencepiece

    lib, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(3)
    texts = ["".join(rng.choice("ab the ing▁ \n\t.é中") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, PIECES).collect()} == {i: len(lib.encode(t)) for i, t in enumerate(texts)}


def test_encoder_equals_the_library(odd_documents):
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(WORDS), random.Random(5)
    texts = [r["text"] for r in odd_documents.collect()] + ["".join(rng.choice("aBcÉß '.s,t12 \n\t\x1c\u3000İΣ́") for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["<|ENDOFTEXT|> A", "<|endoftext|> A"]
    for limit in (0, 10_000):
        for text, ids in zip(texts, Encoder(WORDS, limit).encode(texts), strict=True):
            assert ids == np.array(lib.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes(), repr(text)[:80]


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    lib, of = Tokenizer.from_file(WORDS), defaultdict(list)
    encoded = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    for r in rows:
        of[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = encoded[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        assert r["length"] == min(capacity, len(ids) - r["start"]) and r["start"] == capacity * r["piece"]
    for parts in of.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(of)


def test_packing(odd_documents, empty_documents):
    rows = pack_documents(odd_documents, WORDS, capacity=64).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect()}
    check_packing(rows, texts, 64)
    assert Counter(r["doc_id"] for r in rows)[10] == 2 and {r["doc_id"] for r in rows} == set(texts)
    assert pack_documents(empty_documents, WORDS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_a_packing_near_the_bound(seed):
    rng = random.Random(seed)
    capacity = 64
    counts = Counter(rng.randint(1, capacity) if seed % 2 else rng.choice([64, 40, 24, 22, 21, 3, 1]) for _ in range(rng.randint(1, 3000)))
    runs, bins = plan_sequences(dict(counts), capacity)
    load, seen = defaultdict(list), Counter()
    for size, first, last, start, each, offset in runs:
        for rank in range(first, last + 1):
            load[start + (rank - first) // each].append((offset + (rank - first) % each * size, size))
        seen[size] += last - first + 1
    assert seen == counts and len(load) == bins
    for parts in load.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    lower = max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    assert bins <= 1.12 * lower + 2


def test_language(spark, odd_documents, empty_documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.where("doc_id % 3 != 1")
    network = language_id.train(train, rows=400)
    got = language_id.with_language(docs.where("doc_id % 3 = 1"), network)
    n = got.count()
    assert got.where("lang = lang_pred").count() >= 0.97 * n and got.where("lang_score BETWEEN 0 AND 1").count() == n
    odd = {r["doc_id"]: r for r in language_id.with_language(odd_documents.withColumn("__language", F.lit(1)), network).collect()}
    assert {i for i, r in odd.items() if r["lang_pred"] == "und"} == {4, 5, 6, 9} and odd[7]["lang_pred"] == "de" and odd[4]["lang_score"] == 0 and odd[1]["__language"] == 1
    assert set(odd_documents.columns) <= set(odd[1].asDict()) and len(language_id.with_language(odd_documents, network).collect()) == 12
    assert language_id.train(empty_documents) is None and language_id.with_language(empty_documents, network).count() == 0
    assert {r["lang_pred"] for r in language_id.with_language(odd_documents, None).collect()} == {"und"}


def test_weights_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, other = (language_id.train(d, rows=100) for d in (docs.repartition(1), docs.repartition(7)))
    assert all((a == b).all() for a, b in ((one.ahead.x, other.ahead.x), (one.back.u, other.back.u), (one.v, other.v)))


def plain_positions(net, text):
    """Language probabilities of every byte, one step at a time over the whole text; a gate is the sigmoid of twice its argument."""
    d, states = net.hidden, []
    for unit, data in ((net.ahead, text), (net.back, text[::-1])):
        h, out = np.zeros(d), []
        for byte in data:
            x, u = unit.x[:, byte].astype(float), unit.u.astype(float) @ h
            z, r = 0.5 * (np.tanh((x + u)[:d]) + 1), 0.5 * (np.tanh((x + u)[d : 2 * d]) + 1)
            n = np.tanh(x[2 * d :] + r * u[2 * d :])
            h = (1 - z) * n + z * h
            out.append(h)
        states.append(out)
    logits = np.array([net.v.astype(float) @ np.concatenate([a, b]) + net.c[:, 0] for a, b in zip(states[0], states[1][::-1], strict=True)])
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_positions_equal_a_plain_network_and_windows_change_little():
    rng = np.random.default_rng(3)
    net = language_id.Network(["a", "b", "c"], hidden=5)
    short = [bytes(rng.integers(32, 127, n).tolist()) for n in (1, 2, 17, 100, language_id.CORE)]
    for text, got in zip(short, net.sums([*short, b""]), strict=False):
        assert got == pytest.approx(plain_positions(net, text).sum(0), rel=1e-4)
    long = bytes(rng.integers(32, 127, 3_000).tolist())
    mixed = net.sums([b"", long, short[3]])
    assert not mixed[0].any() and mixed[1] == pytest.approx(plain_positions(net, long).sum(0), rel=0.01) and mixed[2] == pytest.approx(net.sums([short[3]])[0], rel=1e-4)
    assert mixed.sum() == pytest.approx(3_100, rel=1e-3)


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    d = language_id.Direction(rng, 3)
    d.x, d.u = d.x.astype(float), d.u.astype(float)
    data, target = rng.integers(97, 100, (5, 4)), rng.normal(size=(5, 3, 4))

    def loss():
        return float((d.forward(data)[0] * target).sum())

    _, trace = d.forward(data, keep=True)
    gx, gu = d.backward(data, trace, target)
    for w, g, at in ((d.u, gu, (4, 1)), (d.u, gu, (8, 2)), (d.u, gu, (1, 0)), (d.x, gx, (0, 98)), (d.x, gx, (7, 97)), (d.x, gx, (4, 99))):
        old, h = w[at], 1e-6
        w[at] = old + h
        up = loss()
        w[at] = old - h
        down = loss()
        w[at] = old
        assert g[at] == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-7)


def test_toxicity(spark, odd_documents, empty_documents):
    rng = random.Random(1)
    plain = ["".join(rng.choice(["ba", "co", "di", "fu", "lo", "me"]) for _ in range(rng.randint(1, 3))) for _ in range(80)]
    rows = []
    for i in range(240):
        words = rng.choices(plain, k=rng.randint(20, 60))
        if i % 3 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = "grubby" + rng.choice(plain)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = docs.where("doc_id % 4 != 0").select("doc_id", F.col("y").alias("toxic"))
    scorer = toxicity.train(docs.drop("y"), labels.union(labels).union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")))
    got = toxicity.with_toxicity(docs.where("doc_id % 4 = 0"), scorer).collect()
    assert sum((r["toxic_score"] >= 0.5) == (r["y"] == 1) for r in got) >= 0.93 * len(got)
    odd = toxicity.with_toxicity(odd_documents, scorer).collect()
    assert len(odd) == 12 and all(0 <= r["toxic_score"] <= 1 for r in odd)
    none = toxicity.train(docs, labels.where("false"))
    assert {r["toxic_score"] for r in toxicity.with_toxicity(odd_documents, none).collect()} == {0.0}
    assert toxicity.with_toxicity(empty_documents, scorer).count() == 0


def plain_ratios(docs, shown):
    """Grams and log ratios by dictionaries: docs are all texts, shown the labelled (text, class) pairs, each text once."""
    from math import log

    def grams_of(word):
        raw = b"\x01" * 5 + word + b"\x02"
        return [raw[i : i + 6] for i in range(len(raw) - 5)]

    level, base_of = {g for t in docs for w in set(t.lower().encode().split()) for g in grams_of(w)}, []
    for order in range(5, 0, -1):
        n = Counter(g[-order:] for g in level)
        level = set(n)
        total, kinds = Counter(), Counter()
        for g, c in n.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        base_of.append((order, n, total, kinds))

    def base(g):
        out, weight = 0.0, 1.0
        for order, n, total, kinds in base_of:
            h = g[-order:-1]
            out += weight * max(n[g[-order:]] - 0.75, 0) / total[h]
            weight *= 0.75 * kinds[h] / total[h]
        return out + weight / 256

    counts = [Counter(g for t, y in shown if y == k for w in set(t.lower().encode().split()) for g in grams_of(w)) for k in (0, 1)]
    total, kinds = [Counter(), Counter()], [Counter(), Counter()]
    for k in (0, 1):
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1
    out = {}
    for g in counts[0] | counts[1]:
        n = [total[k][g[:-1]] for k in (0, 1)]
        p = [(max(counts[k][g] - 0.75, 0) + 0.75 * kinds[k][g[:-1]] * base(g)) / n[k] if n[k] else base(g) for k in (0, 1)]
        if not all(n):
            continue
        share = (counts[0][g] + counts[1][g]) / sum(n)
        test = 2 * sum(x * log(x / e) for k in (0, 1) for x, e in ((counts[k][g], n[k] * share), (n[k] - counts[k][g], n[k] * (1 - share))) if x)
        if test >= toxicity.SIGNIFICANT and abs(log(p[1] / p[0])) >= log(toxicity.FACTOR):
            out[int.from_bytes(g, "big")] = log(p[1] / p[0])
    return out, base


@pytest.mark.parametrize("parts", [1, 3])
def test_toxicity_equals_a_plain_kneser_ney_scorer(spark, monkeypatch, parts):
    """Counts of whole texts of all labelled documents, beyond the sample of the curve, shared ones of all documents; the score is a rising curve of the ratio by the square root of the length."""
    rng = random.Random(5)
    plain = ["".join(rng.choice(["ba", "co", "di", "fu"]) for _ in range(3)) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(plain, k=20)) + (f" grubby vile{i:03d}" if i % 2 else f" mild{i:03d}"), i % 2) for i in range(200)]
    rows.append((200, " ".join(rng.choices(plain, k=12_000)) + " zonkwix " * 3 + " ".join(rng.choices(plain, k=12_000)), 1))
    rows += [(400 + i, rows[1][1], 1) for i in range(50)]  # copies count once
    texts = [*[r[:2] for r in rows], (300, "unlabelled otherwise grubbier"), (301, None), (302, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    if parts > 1:
        monkeypatch.setattr(toxicity, "MOST_GRAMS", 1)
    scorer = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), per_class=60)
    want, _ = plain_ratios([t for _, t in texts if t], sorted({(t, y) for _, t, y in rows}))
    got = {r["gram"]: r["ratio"] for r in scorer.ratios.where("ratio != 0").collect()}
    assert want and got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in got) and (scorer.parts >= parts)
    assert scorer.slope > 0
    for r in toxicity.with_toxicity(docs, scorer, name="clash").collect():
        words = (r["text"] or "").lower().encode().split()
        raw = [b"\x01" * 5 + w[k : k + 24] + b"\x02" for w in words for k in range(0, len(w), 24)]
        total = sum(want.get(int.from_bytes(x[i : i + 6], "big"), 0) for x in raw for i in range(len(x) - 5))
        mean = total / max(1, sum(len(x) - 5 for x in raw)) ** 0.5
        assert r["clash"] == pytest.approx(1 / (1 + np.exp(-np.clip(scorer.slope * mean + scorer.bias, -30, 30))), abs=1e-6)


def test_shared_model_is_planned_one_order_at_a_time(spark):
    words = Counter(b"the cat sat on the mat and the hat that fat rats had".split())
    grams = [int(g) for g in toxicity.gram_counts(words)[0]]
    table = spark.createDataFrame([(g,) for g in grams], "gram long")
    out = toxicity._with_shared(table, table)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    base, levels = dict.fromkeys(grams, 1 / 256), [Counter(grams)]
    for order in range(toxicity.ORDER - 1, 0, -1):
        levels.append(Counter(g & ((1 << 8 * order) - 1) for g in levels[-1]))
    for order, level in enumerate(reversed(levels[1:]), 1):
        total, kinds = Counter(), Counter()
        for g, n in level.items():
            total[g >> 8] += n
            kinds[g >> 8] += 1
        short = {g: g & ((1 << 8 * order) - 1) for g in grams}
        base = {g: (level[s] - toxicity.DISCOUNT + toxicity.DISCOUNT * kinds[s >> 8] * base[g]) / total[s >> 8] for g, s in short.items()}
    got = {r["gram"]: r["base"] for r in out.collect()}
    assert got.keys() == base.keys()
    assert all(got[g] == pytest.approx(base[g], rel=1e-12) for g in base)


def test_toxicity_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one, other = toxicity.train(docs.repartition(1), labels), toxicity.train(docs.repartition(5), labels.repartition(3))
    assert (one.slope, one.bias) == pytest.approx((other.slope, other.bias), rel=1e-9)
    assert {tuple(r) for r in one.ratios.select("gram", F.round("ratio", 9)).collect()} == {tuple(r) for r in other.ratios.select("gram", F.round("ratio", 9)).collect()}


def test_licenses(spark, odd_documents, empty_documents):
    rows = [
        (1, "Some words.\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."),
        (5, "He lost his license and the doctor was released."), (6, "the quick brown fox"), (7, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0\nReleased under the MIT License."),
    ]
    got = {r["doc_id"]: r for r in licenses.license_summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["families"] for i in range(1, 8)] == ["mit", "apache", "gpl", "cc-by-nc", "", "", "apache,mit"]
    assert got[5]["family"] is None and got[1]["score"] >= licenses.MIN_SCORE
    assert licenses.license_summary(odd_documents).count() == 12 and licenses.license_summary(empty_documents).count() == 0
    assert set(odd_documents.columns) <= set(licenses.with_licenses(odd_documents).columns)


def test_license_scores_equal_plain_numpy(spark):
    m = licenses.trained()
    text = "this file is released under the mozilla public license 2 0"
    z = np.array(m.bias) + sum((np.array(m.weights[g]) for g in licenses.grams(licenses.tokens(text)) if g in m.weights), np.zeros(len(m.bias)))
    p = np.exp(z - z.max())
    row = licenses.with_licenses(spark.createDataFrame([(text,)], "text string")).first()["license_paragraphs"][0]
    assert row["family"] == m.families[int(p.argmax())] and row["score"] == pytest.approx(p.max() / p.sum())


def test_url_filter_paths_agree(spark):
    rules = [*queries.URL_RULES, ("block", "a.b.c", "/x"), ("allow", "a.b.c", "/x"), ("allow", "b.c", "/x/y/"), ("block", "", "/ads/")]
    urls = ["http://foo.net/a", "https://X.Example.NET/en/25?q#f", "http://example.net/en", "http://notexample.net", "http://u.example.com/de/1", "ftp://b.org/fr/", "http://q.a.b.c/xy", "http://b.c/x/y/z", "//no", None, "http://", "://h/p", "http://z/ads/1", "x://a.b.c/x/y/z", "http://foo.net/a"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    by_trie = [tuple(r) for r in U.url_filter(df, rules).orderBy("page_id").collect()]
    kind = spark.createDataFrame(rules, "verdict string, host string, path string")
    heads = df.withColumns({"host": U.host_of(F.col("url")), "path": U.path_of(F.col("url"))})
    by_join = [tuple(r) for r in U._by_join(heads.drop("rule"), kind, "allow").select("page_id", "url", "rule", "host", "path", "verdict").orderBy("page_id").collect()]
    assert by_trie == by_join
    got = {r[0]: (r[2], r[5]) for r in by_trie}
    assert got[0] == ("net/", "block") and got[1] == ("example.net/en/", "allow") and got[2] == ("net/", "block") and got[3] == (None, "allow") and got[4] == ("example.com/de/", "block") and got[5] == ("org/fr/", "allow")
    assert got[6] == ("a.b.c/x", "block") and got[9] == (None, "allow") and got[12] == ("/ads/", "block")
    assert U.url_filter(df.where("false"), rules).count() == 0
    assert U.url_filter(df, kind).count() == len(urls)
    assert U.segments("/en//x") == ["/", "en/", "/", "x"] and U.segments("") == [] and U.Trie(rules).match("a.example.net", "/\0en/x") == ("net/", "block")
    with pytest.raises(ValueError):
        U.Trie([("maybe", "a", "/")])


def test_sharding(spark, odd_documents, empty_documents):
    many = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' WHEN id % 50 = 1 THEN NULL ELSE repeat('ab', CAST(id % 40 AS INT)) || id END AS text")
    rows = SH.shard_by_size(many, 5, items_per_shard=16).collect()
    texts = {r["doc_id"]: r["text"] for r in many.collect()}
    homes, loads, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        homes[texts[r["doc_id"]]].add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 3000 and all(len(s) == 1 for s in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    free = [v for k, v in loads.items() if k != next(iter(homes["the same text"]))]
    assert max(free) <= 1.15 * min(free)
    assert SH.shard_by_size(odd_documents, 3).count() == 12 and SH.shard_by_size(empty_documents, 3).count() == 0
    assert SH.schedule([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    with pytest.raises(ValueError):
        SH.shard_by_size(odd_documents, 0)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    names, expected = rows_of_sql(connect(SF), queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == names and rows_of_spark(df) == expected


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_plain_python(spark, odd_documents, empty_documents):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "b", "the ", " ", "\n", "\n", "#", "é🙂 ", "\x0b", "\x85", "- ", "..."]) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts += [r["text"] for r in odd_documents.collect()] + [" ".join("abcde" * 3), "a b c d e", "a b c d e f\n" * 2, " ".join(map(str, range(40))) + " x " + " ".join(map(str, range(3, 9)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality(df).collect()}
    for i, text in enumerate(texts):
        r, (words, chars, symbols, same, again) = got[i], brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (words, chars, symbols, same, again), repr(text)[:90]
        assert r["base_failed"] == (words < 10 or 100 * again > 20 * words) and (not r["kept"] or not r["base_failed"]) and r["kept"] == (not r["base_failed"] and not r["failed_rules"])
    assert quality(odd_documents).count() == 12 and quality(empty_documents).count() == 0
    clashing = df.limit(1).selectExpr("doc_id", "text", "1 AS n_words", "2 AS c", "true AS kept")
    assert quality(clashing).columns == quality(df).columns and quality(clashing).count() == 1


def test_quality_query_matches_its_sql_and_uses_no_python(spark):
    df = queries.op13_quality(spark, SF)
    names, expected = rows_of_sql(connect(SF), queries.oracle_sql()["op13_quality"])
    assert sorted(df.columns) == names and rows_of_spark(df) == expected
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def brute_runs(words, least, repeats):
    out = []
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, repeats * q) and not any(all(words[t] == words[t + d] for t in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_periodic_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            words = []
            for _ in range(rng.randint(0, 6)):
                kinds = rng.choice([1, 2, 3, 20])
                unit = [b"%d" % rng.randint(0, kinds) for _ in range(rng.randint(1, rng.choice([3, 9, 20, 40])))]
                unit = unit * 2 + [b"x"] if rng.random() < 0.3 else unit
                words += (unit * 8)[: rng.randint(1, 8 * len(unit))]
            docs.append(words)
        for least, repeats in ((24, 3), (3, 3), (10, 4)):
            assert find_runs(docs, least, repeats) == [brute_runs(d, least, repeats) for d in docs]


def test_periodic_runs_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_periodic_runs(spark, SF).collect()
    assert len(got) == len(docs) and sum(r["n_runs"] for r in got) > 0
    for r in got:
        words, h = (docs[r["doc_id"]] or "").encode().split(), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words, 24, 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best) and r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def test_periodic_runs_of_odd_rows(odd_documents, empty_documents, spark):
    got = periodic_runs(odd_documents).collect()
    assert len(got) == 12 and periodic_runs(empty_documents).count() == 0
    of = {r["doc_id"]: r for r in got}
    assert (of[4]["n_words"], of[4]["runs"], of[4]["collapsed"]) == (0, [], "") and of[6]["collapsed"] == ""
    assert [tuple(x) for x in of[7]["runs"]] == [(0, 60_000, 3)] and of[7]["collapsed"] == "der hund schläft"
    huge = spark.createDataFrame([((1 << 62) + 1, "a " * 30), (None, "b")], "doc_id long, text string")
    assert {(r["doc_id"], r["n_words"]) for r in periodic_runs(huge).collect()} == {((1 << 62) + 1, 30), (None, 1)}
    with pytest.raises(ValueError):
        periodic_runs(odd_documents, repeats=2)


class PlainAlignment:
    """Both libraries on whole texts."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.a.encode_special_tokens = True
        self.symbol = byte_of_symbol()

    def __call__(self, text):
        """n_a, n_b, the groups text and the linked pairs."""
        if not text:
            return 0, 0, "", []
        a, b, raw = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text), f" {text}".encode()
        of_a = [bytes(self.symbol[c] for c in self.a.id_to_token(i)) for i in a]
        of_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(of_a) != raw or b"".join(of_b) != raw:
            return 0, 0, "", []
        ends_a, ends_b = list(accumulate(map(len, of_a))), list(accumulate(map(len, of_b)))
        groups, pairs, low = [], [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ([str(i) for e, i in zip(ends, ids, strict=True) if low < e <= end] for ends, ids in ((ends_a, a), (ends_b, b)))
            groups.append(f"{','.join(x)}|{','.join(y)}")
            pairs.append((int(x[-1]), int(y[-1])))
            low = end
        return len(a), len(b), ";".join(groups), pairs


def test_alignment_equals_whole_texts_with_any_memo():
    rng, plain = random.Random(4), PlainAlignment()
    texts = [None, "", " ", "  ", "▁", "a▁b", "<s> </s> <|endoftext|> x<unk>", "a  b", " a", "a ", "\n", "a \n b", "it's I'M 've don't", "\x1c a \x1c", "a \x1cb", "ﬁ x", "\x00 a", "x" * 5000]
    texts += ["".join(rng.choice(["a", " ", " the", "ing", "▁" if rng.random() < 0.02 else "é", "\n", "\t", ".", " ", "中", "'s", "12", "!!", "　", "\x85", "🙂"]) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    expected = [plain(t) for t in texts]
    for limit in (0, 100_000):
        aligner, at = Aligner(BYTES, PIECES, limit), 0
        for part in (texts, texts):
            at = 0
            for counts, groups, pairs, owner in aligner.align(part):
                for k, text in enumerate(groups):
                    a, b, whole, links = expected[at]
                    assert (*counts[k].tolist(), text) == (a, b, len(links), whole), repr(texts[at])
                    assert [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs[owner == k]] == links
                    at += 1
        assert at == len(texts)


def test_alignment_query_equals_brute_force(spark):
    plain = PlainAlignment()
    docs = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    times, most = Counter(p for *_, links in docs.values() for p in links), defaultdict(int)
    for (_, b), n in times.items():
        most[b] = max(most[b], n)
    got = queries.op11_alignment(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        a, b, groups, links = docs[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (a, b, len(links), len(links)) and r["groups_sha256"] == (sha256(groups.encode()).hexdigest() if groups else "")
        assert r["n_best"] == sum(times[p] == most[p[1]] for p in links) and r["count_sum"] == sum(times[p] for p in links)


def test_alignment_of_odd_rows_and_both_joins(odd_documents, empty_documents):
    found = align(odd_documents, BYTES, PIECES)
    wide, shuffled = ({(r["doc_id"], r["n_a"], r["n_b"], r["groups"], r["n_best"], r["count_sum"]) for r in scores(found, most).collect()} for most in (10, 10**9))
    assert wide == shuffled and len(wide) == 11 and scores(found).count() == 12  # one row is there twice
    assert {r[1:] for r in wide if r[0] in (4, 5, 11)} == {(0, 0, "", 0, 0)}
    assert scores(align(empty_documents, BYTES, PIECES)).count() == 0
