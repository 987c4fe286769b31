"""Hashed word features and training samples for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kit

BUCKETS = 1 << 18


def word_counts(words: kit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and count of each distinct hashed word, in the order of texts."""
    key = (words.doc.astype(np.int64) << 18) | (words.hash & kit.U64(BUCKETS - 1)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return key >> 18, key & (BUCKETS - 1), count


def sum_by(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by doc, doc being in ascending order; in float64."""
    out = np.zeros((n, *values.shape[1:]))
    if len(doc):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[first]] = np.add.reduceat(values, first, axis=0, dtype=np.float64)
    return out


STATS = ("log length", "word length", "symbols", "capitals", "digits", "lines", "distinct words", "repeated words", "words in capitals", "lone symbols", "no words")


def structure(raw: np.ndarray, off: np.ndarray, words: kit.Words, distinct: np.ndarray) -> np.ndarray:
    """STATS of each text. raw are the bytes before lower-casing, distinct the number of distinct words."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[off[1:]] - total[off[:-1]]) / size

    kinds = np.zeros(256, np.uint8)
    kinds[65:91], kinds[48:58], kinds[10] = 1, 2, 3
    for c in b"#$%&*|!@^~=+<>{}[]\\/_":
        kinds[c] = 4
    kind = kinds[raw]
    blank = raw == 32
    alone = np.zeros(len(raw), bool)
    if len(raw) > 2:
        alone[1:-1] = (kind[1:-1] == 4) & blank[:-2] & blank[2:]
    count = np.diff(words.first)
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    letters = np.bincount(words.doc, words.end - words.start, n)
    capital = share(kind == 1)
    out = np.stack([np.log1p(np.diff(off)), letters / np.maximum(count, 1), share(kind == 4), capital, share(kind == 2), share(kind == 3), distinct / np.maximum(count, 1), np.bincount(words.doc, same, n) / np.maximum(count, 1), capital > 0.5, share(alone) * 10, count == 0], axis=1)
    return out.astype(np.float32)


def lowest(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """About that share of rows: those whose hash of doc_id is lowest."""
    return rows if share >= 1 else rows.filter(F.xxhash64("doc_id", F.lit(seed)) < F.lit(int(-(2**63) + 2**64 * share)))


def first_ids(ids: DataFrame, most: int, seed: int, but: DataFrame | None = None) -> DataFrame:
    """The `most` distinct doc_id of ids with the lowest hashes, without those in but: an even draw, the same at every run.

    Only about eight times as many as are asked for are made distinct and
    sorted; if repeated ids leave too few of them, all are.
    """
    ids = ids.filter("doc_id is not null").select("doc_id")

    def drawn(share: float) -> DataFrame:
        some = lowest(ids, share, seed).distinct()
        return some if but is None else some.join(but.select("doc_id"), "doc_id", "left_anti")

    share = 8 * most / max(ids.count(), 1)
    some = drawn(share)
    if share < 1 and some.limit(most).count() < most:
        some = drawn(1)
    return some.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def matching(docs: DataFrame, ids: DataFrame, on: list[str] | None = None) -> DataFrame:
    """A row of docs for each doc_id among ids, of which there are few enough to broadcast by first_ids' bound; of repeated ones, one by the hash of its text."""
    on = on or ["doc_id"]
    rank = F.row_number().over(Window.partitionBy(*on).orderBy(F.xxhash64("text"), "text"))
    return docs.join(F.broadcast(ids), on).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def train_in_one_task(rows: DataFrame, fit, schema: str):
    """fit(table) run by one executor task on all rows, a bounded sample; its one row."""
    return rows.groupBy(F.lit(0).alias("_one")).applyInArrow(kit.groupwise(fit), schema).first()


def joined(parts: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
    """The arrays in parts in a row, and the part that each value came from."""
    a = [np.frombuffer(p, kind) for p in parts]
    return (np.concatenate(a) if a else np.empty(0, kind)), np.repeat(np.arange(len(a)), [len(x) for x in a]).astype(np.int64)


def flat(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The arrays in a binary column in a row, without a copy of each, and the row that each value came from."""
    a = column.combine_chunks()
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.binary())
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
    data = a.buffers()[2] if len(a) else None
    values = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(kind) if data is not None and off[-1] > off[0] else np.empty(0, kind)
    return values, np.repeat(np.arange(len(a)), np.diff(off) // np.dtype(kind).itemsize)


def split_rows(doc: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n + 1))
