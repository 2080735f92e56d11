"""Shared helpers: table access, durable cuts of the lineage, per-task memos over words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that reach a Python worker at a time, in bytes.
BATCH_BYTES = 4 << 20
#: Text handled at a time inside a Python worker, in characters.
CHUNK_CHARS = 4_000_000
_written: list[tuple[SparkSession, str]] = []


def bounded(spark: SparkSession) -> None:
    """Arrow batches hold at most BATCH_BYTES, whatever the length of the texts in them, unless the session asks for less."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m").lower().removesuffix("b")
    size = int(now.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(now[-1], 0)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where it is unset, a local one in local mode (as in tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="parcelcube-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage is cut, and any executor can be lost.

    The files are removed by release(), or else when the application ends.
    """
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark).rstrip('/')}/parcelcube-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove the files of settled tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._settled_at)
        _written.remove((df.sparkSession, df._settled_at))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Shipped:
    """A broadcast value whose classes travel with it: workers need no copy of this package.

    Broadcasts are pickled by reference to modules, unlike functions of this package; so the value goes as bytes that hold its
    classes, and a task unpacks them once.
    """

    def __init__(self, spark: SparkSession, value) -> None:  # noqa: ANN001
        self.raw = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self) -> dict:
        return {"raw": self.raw}

    @property
    def value(self):  # noqa: ANN201
        if "kept" not in self.__dict__:
            self.kept = cloudpickle.loads(self.raw.value)
        return self.kept

    def unpersist(self) -> None:
        self.raw.unpersist()


def ship(spark: SparkSession, value) -> Shipped:  # noqa: ANN001
    return Shipped(spark, value)


#: Rows of one key that a task takes in a salted join.
HOT_ROWS = 1_000


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """Join of many with one (one row per key) in which the rows of a key with more than HOT_ROWS are dealt over several tasks by the column `by`.

    Adaptive execution chooses how the list of such keys is joined: it has one in HOT_ROWS of the rows at most.
    """
    hot = many.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select(key, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts"))
    dealt = many.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = one.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def fold(column: str, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % k


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Numbered(dict):
    """word -> row number; an unseen word gets the next row and waits in `new`."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, word):  # noqa: ANN001, ANN204
        row = self[word] = len(self)
        self.new.append(word)
        return row


class WordMemo:
    """Values of distinct words, each worked out once while it stays in the memo.

    score(words) -> array (len(words), width). The memo starts anew beyond `limit` words, so
    memory is bounded; the results are the same with any limit.
    """

    def __init__(self, score: Callable, width: int, limit: int = 400_000, dtype: type = np.float32) -> None:
        self.score, self.width, self.limit, self.dtype = score, width, limit, dtype
        self._clear()

    def _clear(self) -> None:
        self.rows, self.values = Numbered(), np.zeros((0, self.width), self.dtype)

    def sums(self, docs: list[list]) -> np.ndarray:
        """For each list of words, the sum of its words' values (float64)."""
        if len(self.rows) > self.limit:
            self._clear()
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        rows = np.empty(int(lengths.sum()), np.int64)
        get, at = self.rows.__getitem__, 0
        for words in docs:
            rows[at : at + len(words)] = list(map(get, words))
            at += len(words)
        if self.rows.new:
            self._grow(self.score(self.rows.new))
            self.rows.new = []
        owner = np.repeat(np.arange(len(docs)), lengths)
        out = np.empty((len(docs), self.width))
        for k in range(self.width):
            out[:, k] = np.bincount(owner, weights=self.values[:, k][rows], minlength=len(docs))
        return out

    def _grow(self, more: np.ndarray) -> None:
        self.values = np.concatenate([self.values, np.asarray(more, self.dtype).reshape(-1, self.width)])


def by_length(words: list[bytes], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words as byte matrices of equal width: (owning word numbers, matrix). Longer words come in pieces of `most` bytes."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    owner = np.arange(len(words))
    if len(sizes) and sizes.max() > most:
        parts = np.maximum(1, -(-sizes // most))
        owner = np.repeat(owner, parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, sizes = starts[owner] + nth * most, np.minimum(sizes[owner] - nth * most, most)
    order = np.argsort(sizes, kind="stable")
    bounds = np.searchsorted(sizes[order], np.arange(1, most + 2))
    for width, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 1):
        for k in range(a, b, 8192):
            rows = order[k : min(b, k + 8192)]
            yield owner[rows], raw[starts[rows][:, None] + np.arange(width)]


def hash_share(column: str, seed: int) -> Column:
    """A fixed pseudo-random number in [0, 1) per value."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 30)) / float(1 << 30)).cast("double")


def sample_by_class(df: DataFrame, label: str, id_col: str, per_class: int, seed: int = 11) -> DataFrame:
    """About per_class rows of each class, by a hash of the id (so ids are distinct): a bounded sample to fit a classifier on."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n")).collect()  # one row per class
    if not sizes:
        return df.limit(0)
    share = df.sparkSession.createDataFrame([(r[label], min(1.0, per_class / r["n"])) for r in sizes], f"__label {df.schema[label].dataType.simpleString()}, __share double")
    return df.join(F.broadcast(share), F.col(label) == F.col("__label")).where(hash_share(id_col, seed) < F.col("__share")).drop("__label", "__share")
