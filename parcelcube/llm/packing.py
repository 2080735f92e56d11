"""Best-fit packing of tokenised documents into sequences, with large-item matching.

Documents become token ids plus one end id; only those longer than a sequence are cut. Items above a
third of the capacity fit at most twice in a sequence, so a greedy matching pairs each with the largest
partner that still fits; smaller items, by falling size, go to the fullest sequence with room.

The plan needs only how many items each length has, at most `capacity` numbers, and speaks of runs of
alike sequences: (length, ranks, first sequence, items per sequence, offset). Its size depends on the
capacity alone. Items then find their sequence by their rank among the items of their length, which is
counted over hashed buckets of about BUCKET_ROWS rows; rows that repeat are spread over the buckets too.

Defined cases: a null or empty text is the end id alone; texts of any length are cut, never shortened;
repeated rows are packed each; ids of any type stay as they are, null ones too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelcube.llm.common import chunks, settle

BUCKET_ROWS, MOST_BUCKETS = 1_000, 65_536
#: Ids of at most so many words are kept by a task.
MEMO_WORDS = 700_000
#: Characters of text split into words at a time; the words and the encodings of new ones take about thirty times as much.
AT_ONCE = 500_000
#: Control characters that Python takes for white space and the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")


class Encoder:
    """Ids of whole texts through a tokenizer whose tokens never cross white space, one encoding per distinct word."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.limit = Tokenizer.from_file(path), memo_words
        self.lib.no_truncation()
        self.lib.no_padding()
        self.memo: dict[str, bytes] = {}
        # special strings are matched before the case is changed: texts that hold one in any case stay as they are
        self.specials = [t.content.lower() for t in self.lib.get_added_tokens_decoder().values()]
        self.lowers = self.lib.encode("ÀB", add_special_tokens=False).ids == self.lib.encode("àb", add_special_tokens=False).ids

    def _learn(self, words: list[str], odd: set[str]) -> None:
        """Words whose length normalisation keeps are encoded together, joined by spaces; character offsets tell whose each id is.

        A word of letters and one last stop or comma is two pre-tokens, so its letters are shared.
        """
        memo, marked, own = self.memo, [], []
        for word in words:
            if word[-1] in ".," and (stem := word[:-1]).isalpha() and (word not in odd or even(stem)):
                marked.append(word)
                if stem not in memo:
                    memo[stem] = b""
            else:
                own.append(word)
        todo = list(dict.fromkeys([*own, *(w[:-1] for w in marked if memo[w[:-1]] == b""), *((".", ",") if marked else ())]))
        apart = [w for w in todo if w in odd and not even(w)]
        for word, enc in zip(apart, self.lib.encode_batch(apart, add_special_tokens=False), strict=True):
            memo[word] = np.asarray(enc.ids, "<u4").tobytes()
        if apart:
            todo = [w for w in todo if w not in odd or even(w)]
        lines = [todo[i : i + 64] for i in range(0, len(todo), 64)]
        for line, enc in zip(lines, self.lib.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.asarray(enc.ids, np.uint32)
            at = np.fromiter(map(itemgetter(0), enc.offsets), np.int64, len(ids))
            ends = np.cumsum(np.fromiter((len(w) + 1 for w in line), np.int64, len(line)))
            cuts = (4 * np.searchsorted(at, ends, "left")).tolist()
            raw, start = ids.astype("<u4").tobytes(), 0
            for word, end in zip(line, cuts, strict=True):
                memo[word] = raw[start:end]
                start = end
        for word in marked:
            memo[word] = memo[word[:-1]] + memo[word[-1]]

    def words(self, text: str | None) -> tuple[list[str], bool]:
        """White-space delimited words, Latin ones in lower case, as the tokenizer takes them; and whether all are Latin."""
        if not text:
            return [], True
        plain = text.isascii() or latin(text)
        if ODD_SPACE.search(text):
            return [w for w in re.split(r"[ \n\r\t]+", text) if w], plain
        if self.lowers and plain:
            low = text.lower()
            if not any(s in low for s in self.specials):
                return low.split(), plain
        return text.split(), plain

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for a, b in chunks(texts, AT_ONCE):
            if len(self.memo) > self.limit:
                self.memo.clear()
            docs, seen, odd = [], set(), set()
            for text in texts[a:b]:
                words, plain = self.words(text)
                docs.append(words)
                seen.update(words)
                if not plain:
                    odd.update(words)
            self._learn(list(seen.difference(self.memo)), odd)
            get = self.memo.__getitem__
            for words in docs:
                yield b"".join(map(get, words))


def even(word: str) -> bool:
    """Normalisation keeps the number of characters, as in all Latin words, so offsets tell words apart."""
    return unicodedata.is_normalized("NFC", word) and len(word.lower()) == len(word)


def latin(text: str) -> bool:
    """All characters are below U+0100: there, lower case goes by single characters."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces_of(df: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids_crc32: documents cut where they are longer than the capacity."""
    end = np.array([end_id], "<u4").tobytes()

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(tokenizer)
        for texts in parts:
            out = []
            for ids in encoder.encode(texts.tolist()):
                ids += end
                starts = range(0, len(ids) // 4, capacity)
                pieces = [ids[4 * start : 4 * (start + capacity)] for start in starts]
                out.append([{"piece": n, "start": start, "length": len(x) // 4, "ids_crc32": zlib.crc32(x)} for n, (start, x) in enumerate(zip(starts, pieces, strict=True))])
            yield pd.Series(out, dtype=object)

    return df.select(F.col(id_col), F.explode(cut(F.col(text_col))).alias("__p")).select(id_col, "__p.*")


def plan_sequences(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, last rank, first sequence, items per sequence, offset) and the number of sequences."""
    left = {size: n for size, n in counts.items() if n}
    large = sorted(size for size in left if 3 * size > capacity)
    taken = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), by rising gap
    bins = 0

    def put(size: int, first: int, sequences: int, each: int, offset: int) -> None:
        n = sequences * each
        runs.append((size, taken[size], taken[size] + n - 1, first, each, offset))
        taken[size] += n
        left[size] -= n

    for size in reversed(large):
        while left[size]:
            k = bisect_left(large, capacity - size + 1)
            mate = next((s for s in reversed(large[:k]) if left[s] - (s == size) > 0), None)
            n = left[size] if mate is None else left[size] // 2 if mate == size else min(left[size], left[mate])
            put(size, bins, n, 1, 0)
            if mate is not None:
                put(mate, bins, n, 1, size)
            insort(gaps, (capacity - size - (mate or 0), bins, n))
            bins += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            k = bisect_left(gaps, (size, -1, -1))
            if k == len(gaps):
                n = max(1, left[size] // (capacity // size))
                gap, first = capacity, bins
                bins += n
            else:
                gap, first, n = gaps.pop(k)
            each = min(gap // size, left[size])
            used = min(n, left[size] // each)
            put(size, first, used, each, capacity - gap)
            insort(gaps, (gap - size * each, first, used))
            if used < n:
                insort(gaps, (gap, first + used, n - used))
    return runs, bins


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces (id_col, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    pieces = settle(pieces.withColumn("__row", F.monotonically_increasing_id()))  # written once, so the numbers stay
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs, _ = plan_sequences(counts, capacity)
    plan = spark.createDataFrame(runs, "length long, first long, last long, sequence long, each long, at long")
    buckets = spark.createDataFrame([(size, min(MOST_BUCKETS, -(-n // BUCKET_ROWS))) for size, n in counts.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("__row"), F.col("buckets")))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("__row")) - 1
    ranked = dealt.withColumn("inside", inside).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    nth = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(plan.withColumnRenamed("length", "size")), (F.col("length") == F.col("size")) & F.col("rank").between(F.col("first"), F.col("last")))
        .select(id_col, "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"))
    )


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces_of(df, tokenizer, capacity, end_id, id_col, text_col), capacity, id_col)
