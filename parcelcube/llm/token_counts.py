"""Token counts with a whole-token shortcut over a sentencepiece BPE vocabulary.

Offline proof, made once per task from the model alone: (1) no piece has a word mark after another
character, so merges never cross the start of a word and a text's count is the sum over its words;
(2) which pieces that start with the mark encode, alone, as exactly that one token. Words found in
that table count as one; only the others are merged by the library, once while they stay in the memo.
If (1) fails for a model, whole texts go through the library.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; very
long texts are processed in bounded chunks of rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcube.llm.common import WordMemo, chunks

MARK = "▁"
#: Results of at most so many merged words are kept by a task.
MEMO_WORDS = 400_000


class Counter:
    def __init__(self, model: str, memo_words: int = MEMO_WORDS) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and self._marks_spaces()
        words = [(i, p[1:]) for i, p in enumerate(pieces) if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        alone = self.lib.encode([w for _, w in words], num_threads=1)
        self.whole = {w: 1 for (i, w), ids in zip(words, alone, strict=True) if ids == [i]} if self.splits else {}
        self.memo = WordMemo(self._merge, 1, memo_words, np.int64)

    def _marks_spaces(self) -> bool:
        """The normaliser keeps every space as a mark and puts one before the text."""
        return self.lib.decode(self.lib.encode(" a  b ")) == " a  b " and self.lib.encode("a", out_type=str)[0].startswith(MARK)

    def _merge(self, words: list[str]) -> np.ndarray:
        """A lone mark is one token, unless the text is empty, which count() knows."""
        out = np.ones((len(words), 1), np.int64)
        rest = [i for i, w in enumerate(words) if w and w not in self.whole]
        for i, ids in zip(rest, self.lib.encode([words[i] for i in rest], num_threads=1), strict=True):
            out[i] = len(ids)
        return out

    def words(self, text: str) -> list[str]:
        """Words without their first mark; more marks stay in front."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
            return text.split(" ")
        return [s[1:] for s in re.findall(r" +[^ ]*", f" {text}")]

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for a, b in chunks(texts):
            if self.splits:
                docs = [self.words(t) if t else [] for t in texts[a:b]]
                out[a:b] = self.memo.sums(docs)[:, 0].astype(np.int64)
            else:
                out[a:b] = [len(x) for x in self.lib.encode([t or "" for t in texts[a:b]], num_threads=1)]
        return out


def token_counts(df: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_bytes, n_tokens, over_limit (n_tokens > limit). model: a sentencepiece file every executor can read."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(model)
        for texts in parts:
            yield pd.Series(counter.count(texts.tolist()))

    return df.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), count(F.col(text_col)).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
