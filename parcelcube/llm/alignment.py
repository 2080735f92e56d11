"""Alignment of two tokenizers: A byte-level BPE, B sentencepiece, over the bytes of a space and the text.

Each byte gets a label: no token ends with it (0), one of A (1), one of B (2), one of both (3). A regex scan takes the labels up to
each 3 as a span; how many of its labels are 1 or 3, and 2 or 3, says how many tokens of A and of B form the group. Tokens hold a
byte at least, so a span ends with exactly one linked pair: its last tokens of A and B.

Both tokenizers cut before a space that follows no other space and precedes a character that is no white space (for B this is proved
from its pieces, as in token_counts), so texts are cut there and a piece of text is encoded and aligned once while it stays in a
task's memo. If B is no such model, or if a piece of text does not come back byte by byte, the whole text goes through both libraries.

Corpus-wide, an id pair counts the links that hold it. align() gives each text's own pairs with their numbers; scores() adds the counts
of all texts up and brings them back: by a broadcast if there are at most BROADCAST_PAIRS pairs, by a salted shuffle otherwise.

Defined cases: a null or empty text, or one that a tokenizer does not give back byte by byte, has no tokens and an empty groups text;
special strings are plain text; very long texts are aligned whole; equal rows are aligned each; ids of any type stay as they are, null
ones too; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelcube.llm.common import Numbered, bounded, chunks, salted_join, settle
from parcelcube.llm.token_counts import MARK
from parcelcube.llm.token_counts import Counter as PieceModel

#: Pieces of text whose alignment a task keeps.
MEMO_PIECES = 300_000
#: So many are encoded together.
LINE = 64
#: Longer label spans are counted each time.
LONG_SPAN = 24
#: Id pairs whose counts are broadcast, of about 40 bytes each; more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
#: Where a text may be cut: before a space that stands alone and precedes a visible character.
CUT = re.compile(r"(?<! )(?= [^\s᠎])")
#: Cuts are at all spaces and nowhere else unless this is found.
UNEVEN = re.compile(r"  | [\s᠎]|^ | $")
SPAN = re.compile(rb"[^\x03]*\x03")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write visible Latin-1 characters as themselves and the other bytes, in order, as characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Spans(dict):
    """Label span -> its tokens of A, its tokens of B and its bytes."""

    def __missing__(self, span: bytes) -> tuple[int, int, int]:
        self[span] = found = span.count(1) + 1, span.count(2) + 1, len(span)
        if len(span) > LONG_SPAN:
            del self[span]
        return found


class Groups:
    """Groups of numbered pieces; a piece without any was not given back byte by byte."""

    def __init__(self, n: int) -> None:
        self.n_a, self.n_b, self.links = np.zeros((3, n), np.int64)
        self.texts = [""] * n
        self.piece: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []

    def add(self, piece: np.ndarray, cut: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, texts: list[str], pairs: np.ndarray) -> None:
        """Groups cut[i] to cut[i + 1] belong to piece[i]; of_a, of_b: tokens before each cut."""
        self.n_a[piece], self.n_b[piece], self.links[piece] = np.diff(of_a), np.diff(of_b), np.diff(cut)
        at = cut.tolist()
        for i, k in enumerate(piece.tolist()):
            self.texts[k] = ";".join(texts[at[i] : at[i + 1]])
        self.piece.append(piece)
        self.size.append(np.diff(cut))
        self.pairs.append(pairs)


class Aligner:
    def __init__(self, a: str, b: str, memo_pieces: int = MEMO_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        symbol, size = byte_of_symbol(), self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(symbol[c] for c in t) if all(c in symbol for c in t) else t.encode() for t in entries]
        model = PieceModel(b)
        self.b, self.splits = model.lib, model.splits
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := BYTE_PIECE.fullmatch(p)) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.limit, self.spans = memo_pieces, Spans()
        self._clear()

    def _clear(self) -> None:
        self.rows = Numbered()
        self.n_a, self.n_b, self.links = np.zeros((3, 0), np.int64)
        self.groups: list[str] = []
        self.ok: list[bool] = []
        self.flat, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Aligns new pieces, each with the space it starts with.

        Those of a space and visible characters are encoded LINE at a time and aligned all at once. Where a line does not come
        back byte by byte, its pieces are aligned one by one, as all other pieces are.
        """
        plain = [k for k, p in enumerate(pieces) if len(p) > 1 and not UNEVEN.search(p, 1)]
        taken = set(plain)
        odd = [k for k, p in enumerate(pieces) if len(p) > 1 and k not in taken]
        found = Groups(len(pieces))
        again = self._align([plain[k : k + LINE] for k in range(0, len(plain), LINE)], pieces, found)
        self._align([[k] for k in [*again, *odd]], pieces, found)
        order = np.argsort(np.repeat(np.concatenate([np.zeros(0, np.int64), *found.piece]), np.concatenate([np.zeros(0, np.int64), *found.size])), kind="stable")
        self.flat = np.concatenate([self.flat, np.concatenate([np.zeros(0, np.int64), *found.pairs])[order]])
        self.n_a, self.n_b, self.links = np.concatenate([self.n_a, found.n_a]), np.concatenate([self.n_b, found.n_b]), np.concatenate([self.links, found.links])
        self.groups += found.texts
        self.ok += (found.links > 0).tolist()
        self.ends = np.concatenate([[0], np.cumsum(self.links)])

    def _align(self, lines: list[list[int]], pieces: list[str], found: Groups) -> list[int]:
        """Adds the groups of all pieces of these lines to `found`; returns the pieces of lines that were not given back."""
        texts = ["".join([pieces[k] for k in line]) for line in lines]
        a = [enc.ids for enc in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        raw = [t.encode() for t in texts]
        good = [b"".join([self.bytes_a[i] for i in x]) == r == b"".join([self.bytes_b[i] for i in y]) for r, x, y in zip(raw, a, b, strict=True)]
        ids_a, ids_b = ([i for ids, fine in zip(of, good, strict=True) if fine for i in ids] for of in (a, b))
        piece = np.array([k for line, fine in zip(lines, good, strict=True) if fine for k in line], np.int64)
        if len(piece):
            label = np.zeros(sum(len(r) for r, fine in zip(raw, good, strict=True) if fine), np.uint8)
            all_a, all_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
            label[np.cumsum(self.sizes_a[all_a]) - 1] |= 1
            label[np.cumsum(self.sizes_b[all_b]) - 1] |= 2
            spans = SPAN.findall(label.tobytes())
            sizes = np.array(list(map(self.spans.__getitem__, spans)), np.int64)
            to_a, to_b, to_byte = np.cumsum(sizes, 0).T
            texts = [
                f"{ids_a[x - 1]}|{ids_b[y - 1]}" if n == m == 1 else f"{','.join(map(str, ids_a[x - n : x]))}|{','.join(map(str, ids_b[y - m : y]))}"
                for (n, m, _), x, y in zip(sizes.tolist(), to_a.tolist(), to_b.tolist(), strict=True)
            ]
            cut = np.concatenate([[0], np.searchsorted(to_byte, np.cumsum([len(pieces[k].encode()) for k in piece.tolist()])) + 1])
            found.add(piece, cut, np.concatenate([[0], to_a])[cut], np.concatenate([[0], to_b])[cut], texts, all_a[to_a - 1] << 32 | all_b[to_b - 1])
        return [k for line, fine in zip(lines, good, strict=True) if not fine and len(line) > 1 for k in line]

    def cut(self, text: str) -> list[str]:
        if UNEVEN.search(text):
            return CUT.split(f" {text}")
        return [f" {w}" for w in text.split(" ")]

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, np.ndarray]]:
        """Of each range of texts: numbers of A tokens, B tokens and groups (n, 3); groups texts; linked pairs of all texts; their text."""
        for start, end in chunks(texts, 1_000_000):
            if len(self.rows) > self.limit:
                self._clear()
            docs = []
            for text in texts[start:end]:
                pieces = [p for p in self.cut(text) if p] if text and self.splits and MARK not in text else []
                docs.append([self.rows[p] for p in pieces])
                if text and not pieces:
                    docs[-1] = [self.rows[("whole", text)]]
            new, self.rows.new = self.rows.new, []
            self._learn_all(new)
            whole = [k for k, rows in enumerate(docs) if len(rows) > 1 and not all(map(self.ok.__getitem__, rows))]
            if whole:
                for k in whole:
                    docs[k] = [self.rows[("whole", texts[start + k])]]
                new, self.rows.new = self.rows.new, []
                self._learn_all(new)
            yield self._collect(docs)

    def _learn_all(self, new: list) -> None:
        """Rows in their order: pieces together, whole texts one by one."""
        at = 0
        while at < len(new):
            end = at
            while end < len(new) and isinstance(new[end], str):
                end += 1
            if end > at:
                self._learn(new[at:end])
            else:
                self._learn([f" {new[at][1]}"])
                end += 1
            at = end

    def _collect(self, docs: list[list[int]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        rows = np.fromiter((r for doc in docs for r in doc), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(docs)), sizes)
        counts = np.stack([np.bincount(owner, weights=v[rows], minlength=len(docs)) for v in (self.n_a, self.n_b, self.links)], 1).astype(np.int64)
        texts = [";".join([self.groups[r] for r in doc]) for doc in docs]
        links = self.links[rows]
        place = np.arange(int(links.sum())) - np.repeat(np.cumsum(links) - links, links) + np.repeat(self.ends[rows], links)
        return counts, texts, self.flat[place], np.repeat(owner, links)


def tallies(pairs: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct pairs: offsets of the n texts, pairs, and how often each."""
    known, row = np.unique(pairs, return_inverse=True)
    keys, times = np.unique(owner * max(1, len(known)) + row, return_counts=True)
    doc, which = np.divmod(keys, max(1, len(known)))
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]), known[which], times


def align(df: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: ids of A and B by group) and pairs (a, b, n: linked n times in this text).

    a, b: files of a byte-level BPE (tokenizers) and of a sentencepiece model that every executor can read.
    """
    bounded(df.sparkSession)
    rows = df.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)
        for batch in batches:
            at = 0
            for counts, groups, pairs, owner in aligner.align(batch.column(1).to_pylist()):
                ends, pair, times = tallies(pairs, owner, len(groups))
                cells = pa.StructArray.from_arrays([pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(times.astype(np.int32))], ["a", "b", "n"])
                ids = batch.column(0).slice(at, len(groups))
                at += len(groups)
                numbers = [pa.array(counts[:, k]) for k in (0, 1, 2, 2)]
                yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)], [id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    return rows.mapInArrow(aligned, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<a:int,b:int,n:int>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (links of all texts that hold the pair) and best (no other a has more links with this b)."""
    counts = aligned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def scores(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """aligned, as rows of align() with any further columns, with n_best (links whose pair is best) and count_sum (counts added over links) for pairs.

    aligned is read twice and should be a settled table. A row of its own number carries the sums, so rows may be equal.
    """
    numbered = settle(aligned.withColumn("__row", F.monotonically_increasing_id()))
    key = (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair")
    counts = settle(pair_counts(numbered).select(key, "count", "best"))
    own = numbered.select("__row", F.explode("pairs").alias("p")).select("__row", "p.*").select("__row", "n", key)
    both = own.join(F.broadcast(counts), "pair") if counts.count() <= broadcast_pairs else salted_join(own, counts, "pair", "__row")
    sums = both.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = numbered.join(sums, "__row", "left").drop("__row", "pairs")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
