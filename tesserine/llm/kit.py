"""Vectorised text helpers and lineage cuts shared by the operators.

Python workers see Arrow batches; texts stay in one contiguous byte buffer and
are cut into words by array operations, never word by word.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters of the lower-cased text; every other ASCII character separates.
A null text has no words.
"""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import lineage

U64 = np.uint64
BASE = pow(0x9E3779B97F4A7C15, 3, 1 << 64) | 1
BASE_INV = pow(BASE, -1, 1 << 64)
SALTS = np.array([(0xD6E8FEB86659FD93 * (2 * k + 1) ^ 0xA0761D6478BD642F) & (2**64 - 1) | 1 for k in range(64)], U64)
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # not glibc
    _libc = None


ensure_checkpoint_dir = lineage.shared_folder
cut = lineage.cut


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy() -> None:
    """Gives memory that a worker no longer uses back to the system; a worker lives on for later stages."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def batch_rows(spark: SparkSession, most: int = 1000) -> None:
    """Has Arrow batches hold `most` rows instead of Spark's 10000, as rows hold whole texts; a session's own setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(most))


def batchwise(run):
    """run, a function for mapInArrow, in small batches, and the worker's memory tidied at a partition's end."""
    batch_rows(SparkSession.active())

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidied


def groupwise(run):
    """run, a function for applyInArrow, the worker's memory tidied after each group."""
    batch_rows(SparkSession.active())

    def tidied(t: pa.Table) -> pa.Table:
        try:
            return run(t)
        finally:
            tidy()

    return tidied


SMALL = 500_000  # rows of a name and two or three integers that may be broadcast


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few rows; else it is joined by shuffling."""
    return F.broadcast(df) if rows <= SMALL else df


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 16) * 5 // 4
        for name, b in (("up", BASE), ("down", BASE_INV)):
            a = np.full(size, b, U64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=U64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def slices(batches, column: str = "text", most: int = 1 << 20, most_rows: int = 60_000):
    """Sub-batches of about `most` bytes of text; a longer text is alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, n = 0, batch.num_rows
        while at < n:
            done = int(sizes[at - 1]) if at else 0
            to = min(max(int(np.searchsorted(sizes, done + most, "right")), at + 1), n, at + most_rows)
            yield batch.slice(at, to - at)
            at = to


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 places where texts begin."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


class Words:
    """The words of some texts: data, off (bytes), start, end, doc (per word), and hash (64 bits per word)."""

    def __init__(self, texts: pa.Array, lower: bool = True) -> None:
        texts = pc.fill_null(texts, "")
        self.data, self.off = string_bytes(pc.utf8_lower(texts) if lower else texts)
        self.n = len(self.off) - 1
        at = WORD[self.data]
        before, after = np.empty_like(at), np.empty_like(at)
        if len(at):
            before[0], before[1:], after[-1], after[:-1] = False, at[:-1], False, at[1:]
            edge = self.off[1:-1]
            edge = edge[(edge > 0) & (edge < len(at))]
            before[edge], after[edge - 1] = False, False
        self.start = np.flatnonzero(at & ~before)
        self.end = np.flatnonzero(at & ~after) + 1
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        up, down = powers(len(self.data))
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(self.data)], out=total[1:])
        self._total, self._down = total, down
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))

    def beginning(self, k: int, which: np.ndarray) -> np.ndarray:
        """Hash of the first k bytes of the words at which; they must have as many."""
        start = self.start[which]
        return mix((self._total[start + k] - self._total[start]) * self._down[start])

    def grams(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first word of every run of n words. With short, a text of 1 to n - 1 words gives one gram of them all."""
        m = len(self.hash) - n + 1
        if m > 0:
            h = self.hash[:m] * SALTS[0]
            for k in range(1, n):
                h = h + self.hash[k : k + m] * SALTS[k]
            at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
            h, doc = mix(h[at]), self.doc[at]
        else:
            h, doc, at = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
        if short:
            count = np.diff(self.first)
            few = np.flatnonzero((count > 0) & (count < n))
            if len(few):
                with np.errstate(over="ignore"):
                    g = np.array([np.sum(self.hash[self.first[d] : self.first[d + 1]] * SALTS[: count[d]], dtype=U64) + SALTS[63] * U64(count[d]) for d in few], U64)
                h, doc, at = np.concatenate([h, mix(g)]), np.concatenate([doc, few]), np.concatenate([at, self.first[few]])
                order = np.argsort(at, kind="stable")
                h, doc, at = h[order], doc[order], at[order]
        return h, doc, at


def ranges(count: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, in a row."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def distinct_by_doc(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, in the order of (text, hash)."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def in_sorted(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def measure(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and bytes of text, of all the input."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return int(row.n), int(row.b or 0)


def parts(amount: float, each: float) -> int:
    return max(1, math.ceil(amount / each))


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
