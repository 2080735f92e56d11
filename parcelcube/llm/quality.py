"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule bounds a count of a text by another: `least * per <= 1000 * count <= most * per`, in thousandths and whole numbers, so
that every engine gets the same verdict. RULES is the table; callers may pass their own over the same measures.
Words are stretches without ASCII white space, lines are split at line feeds, and a line counts if it holds a word.

Words in repeated windows are found without joins: windows become one sorted array of (hash, position) numbers; only neighbours
that agree in the hash are compared as text, so the count is exact, and a text costs n log n whatever its length.

Defined cases: a null text counts as one without words, which fails the least number of words; empty and very long texts are
counted whole; repeated rows are judged each; ids stay as they are, null ones too; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelcube.llm.common import bounded

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition counts.
WINDOW = 5
#: Base thresholds: fewest words, and the percentage of words that may stand in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with", "der", "die", "das", "und", "den", "ist", "von", "zu", "mit", "auf",
    "le", "la", "les", "et", "des", "est", "une", "un", "que", "de", "en", "el", "los", "las", "y", "se", "por", "con",
)


class Rule(NamedTuple):
    """Keep texts with least <= 1000 * count / per <= most; a text with `per` of 0 passes."""

    name: str
    count: str
    per: str
    least: int = 0
    most: int = 1 << 40


RULES = (
    Rule("word_length", "word_chars", "n_words", 1_500, 25_000),
    Rule("symbols", "n_symbols", "n_words", 0, 500),
    Rule("stop_words", "n_stop_words", "n_words", 5),
    Rule("letters", "n_letters", "word_chars", 500),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0, 500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 0, 900),
    Rule("cut_lines", "n_cut_lines", "n_lines", 0, 300),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, also where lambdas inside body use it for each element."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of `window` words found at least twice, the first one included."""
    n = F.size(words) - window + 1

    def covered(at: Column) -> Column:
        """Words under windows that start at these rising positions."""
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - i, F.lit(window)))), F.lit(0), lambda a, b: a + b)

    def exact(at: Column) -> Column:
        """Of these positions, those whose windows are equal as text to another of them."""
        texts = F.sort_array(F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i + 1, window), " ").alias("t"), i.alias("i"))))
        return let(texts, lambda ts: let(F.sort_array(F.transform(F.filter(ts, lambda s, k: (s["t"] == F.get(ts, k - 1)["t"]) | (s["t"] == F.get(ts, k + 1)["t"])), lambda s: s["i"])), covered))

    def alike(keys: Column, low: Column) -> Column:
        """keys: sorted numbers, a window's hash in the high bits and its position in the low ones."""
        same = lambda a, b: a.bitwiseXOR(b).between(F.lit(0), low)
        found = F.filter(keys, lambda p, k: same(p, F.get(keys, k - 1)) | same(p, F.get(keys, k + 1)))
        return let(F.transform(found, lambda p: p.bitwiseAND(low).cast("int")), lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(exact(at)))

    def searched(hashes: Column) -> Column:
        """hashes: of all windows. Sorting and comparing wait for a hash that is not the only one of its kind."""
        keys = lambda low: F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
        return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).otherwise(let(_ones(n), lambda low: let(keys(low), lambda k: alike(k, low))))

    def keyed(hashed: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[hashed[i + j] for j in range(window)])), searched)

    return F.when(n < 2, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), keyed))


def _ones(n: Column) -> Column:
    """A number of binary ones as long as n, so at least n."""
    return F.conv(F.repeat(F.lit("1"), F.length(F.bin(n))), 2, 10).cast("long")


def measures(text: Column) -> Column:
    """A struct of the counts that rules bound."""

    def of(words: Column, lines: Column, whole: Column) -> Column:
        stop = [form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())]
        count = lambda items, test: F.size(F.filter(items, test)).cast("long")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            count(words, lambda w: w.isin(stop)).alias("n_stop_words"),
            F.length(F.regexp_replace(whole, r"\P{L}+", "")).cast("long").alias("n_letters"),
            count(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")).alias("n_bullet_lines"),
            count(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")).alias("n_cut_lines"),
        )

    whole = F.coalesce(text, F.lit(""))
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    return let(whole, lambda t: let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: let(lines(t), lambda x: of(w, x, t))))


def passes(rule: Rule, counts: Column) -> Column:
    scaled, per = 1000 * counts[rule.count], counts[rule.per]
    return (scaled >= rule.least * per) & (scaled <= rule.most * per)


def quality(df: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the five base counts, base_failed, kept, and failed_rules: the names of the rules of the table that a text breaks."""
    bounded(df.sparkSession)
    c = F.col("c")
    counted = df.select(F.col(id_col).alias(id_col), measures(F.col(text_col)).alias("c"))
    base_failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
    broken = F.array_compact(F.array(*[F.when(~passes(r, c), F.lit(r.name)) for r in rules]))
    base = [c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return counted.select(id_col, *base, base_failed.alias("base_failed"), broken.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
