"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The documents' frequencies of all n-grams of the test items are counted over
all documents. An item's seeds are its n-grams that occur in at most `rare`
documents, and in any case the min_seeds rarest that occur at all, and the
four rarest of each BLOCK of words. Where a document holds a seed, the stretch around it that could
hold the item is cut out, hits on nearby diagonals sharing one stretch, and
aligned word by word with the item (match 2, mismatch -1, gap -1). The score,
over twice the words of the item, is 1 for an exact copy and stays high for
paraphrased or edited ones. For copies of parts it is over twice the words of
the document, where that is shorter than the item (LEAST words at least), and
the score of PASSAGE matching words reaches the threshold in any case.

Items are broadcast in slices of slice_bytes of text; a larger benchmark
takes more passes, and no item is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

MATCH, MISMATCH, GAP = 2, 1, 1
PASSAGE, BLOCK, LEAST = 50, 25, 15
SCHEMA = "doc_id long, item_id long, score double, first_word long, seeds int"


class Items:
    """Words, n-grams and seeds of a slice of test items."""

    def __init__(self, ids: list[int], texts: list[str], n: int) -> None:
        words = kit.Words(pa.array(texts, pa.string()))
        self.ids, self.n = np.array(ids, np.int64), n
        self.words, self.first = words.hash, words.first
        self.hash, self.item, at = words.grams(n, short=True)
        self.pos = at - self.first[self.item]
        self.table = np.unique(self.hash)

    def choose(self, df: np.ndarray, most: int, min_seeds: int) -> None:
        """df: the documents that hold each n-gram of table; most: as many hold a rare one. Keeps the seeds, as a sorted table with the places of each."""
        df = df[np.searchsorted(self.table, self.hash)]
        there = np.flatnonzero(df > 0)
        rank = there[np.lexsort((self.hash[there], df[there], self.item[there]))]
        count = np.bincount(self.item[there], minlength=len(self.ids))
        begin = np.cumsum(count) - count
        place = np.arange(len(rank)) - begin[self.item[rank]]
        block = self.pos[there] // BLOCK
        local = np.lexsort((self.hash[there], df[there], block, self.item[there]))
        item, block = self.item[there][local], block[local]
        start = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (block[1:] != block[:-1])][: len(local)])
        within = np.arange(len(local)) - np.repeat(start, np.diff(np.r_[start, len(local)]))
        seed = np.union1d(rank[(place < min_seeds) | (df[rank] <= most)], there[local[within < 4]])
        order = seed[np.argsort(self.hash[seed], kind="stable")]
        self.seed_item, self.seed_pos = self.item[order], self.pos[order]
        self.seeds, self.seed_first = np.unique(self.hash[order], return_index=True)
        self.seed_first = np.r_[self.seed_first, len(order)]
        del self.hash, self.item, self.pos, self.table


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs of word sequences, many at a time."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda k: (len(items[k]), len(windows[k])))
    at = 0
    while at < len(order):
        to, wide = at, 0
        while to < len(order) and (to == at or max(wide, len(windows[order[to]])) * (to - at + 1) <= 1 << 19) and len(items[order[to]]) <= len(items[order[at]]) * 1.3 + 4:
            wide = max(wide, len(windows[order[to]]))
            to += 1
        part = order[at:to]
        tall = max(len(items[k]) for k in part)
        a, b = np.zeros((len(part), tall), np.uint64), np.ones((len(part), wide), np.uint64)
        in_a, in_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
        for r, k in enumerate(part):
            a[r, : len(items[k])], b[r, : len(windows[k])] = items[k], windows[k]
            in_a[r, : len(items[k])], in_b[r, : len(windows[k])] = True, True
        slope = np.arange(wide, dtype=np.int32) * GAP
        h = np.zeros((len(part), wide + 1), np.int32)
        best = np.zeros(len(part), np.int32)
        for i in range(tall):
            same = (a[:, i : i + 1] == b) & in_b & in_a[:, i : i + 1]
            row = np.maximum(h[:, :-1] + np.where(same, MATCH, -MISMATCH), h[:, 1:] - GAP)
            np.maximum(row, 0, out=row)
            h[:, 1:] = np.maximum.accumulate(row + slope, axis=1) - slope
            np.maximum(best, h[:, 1:].max(1, initial=0), out=best)
        out[part] = best
        at = to
    return out


def found_in(texts: pa.Array, items: Items, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts and items whose alignment reaches the threshold: text, item, the best score, where its stretch begins, and the seeds in it."""
    words = kit.Words(texts)
    h, doc, at = words.grams(items.n, short=True)
    hit, which = kit.in_sorted(h, items.seeds)
    doc, at, which = doc[hit], at[hit], which[hit]
    if not len(doc):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0), none, none
    times = items.seed_first[which + 1] - items.seed_first[which]
    rep = np.repeat(np.arange(len(which)), times)
    e = np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times) + items.seed_first[which][rep]
    doc, item = doc[rep], items.seed_item[e]
    diagonal = at[rep] - items.seed_pos[e]
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    size = np.diff(items.first)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > size[item[1:]] // 4 + 4)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    doc, item, seeds = doc[first], item[first], np.diff(np.r_[first, len(diagonal)])
    slack = size[item] // 3 + 4
    begin = np.maximum(diagonal[first] - slack, words.first[doc])
    end = np.minimum(diagonal[last] + size[item] + slack, words.first[doc + 1])
    score = align([items.words[items.first[i] : items.first[i + 1]] for i in item], [words.hash[x:y] for x, y in zip(begin, end, strict=True)])
    least = np.minimum(size[item], np.maximum(np.diff(words.first)[doc], LEAST))
    score = np.minimum(score / (MATCH * np.clip(least, 1, PASSAGE / threshold)), 1.0)
    order = np.lexsort((begin, -score, item, doc))
    order = order[score[order] >= threshold]
    best = np.ones(len(order), bool)
    best[1:] = (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1])
    order = order[best]
    return doc[order], item[order], score[order], begin[order] - words.first[doc[order]], seeds[order]


def counts(docs: DataFrame, items: Items) -> np.ndarray:
    """Of each n-gram of items, the number of documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast((items.table, items.n))

    def run(batches):
        table, n = shared.value
        total = np.zeros(len(table), np.int64)
        for b in kit.slices(batches):
            h, doc, _ = kit.Words(b.column("text")).grams(n, short=True)
            hit, at = kit.in_sorted(h, table)
            pair = np.unique(doc[hit] * len(table) + at[hit])
            total += np.bincount(pair % len(table), minlength=len(table))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    out = np.zeros(len(items.table), np.int64)
    sums = docs.mapInArrow(kit.batchwise(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # no more rows than the slice has n-grams
    out[sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    return out


def sliced(docs: DataFrame, benchmark: DataFrame, n: int, rare: int, min_seeds: int, slice_bytes: int) -> Iterator[Items]:
    """The benchmark's items with their seeds, slice by slice."""
    slim = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null and text <> ''")
    _, size = kit.measure(slim)
    parts = kit.parts(size, slice_bytes)
    for k in range(parts if size else 0):
        rows = slim.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        items = Items([(-1 if i is None else i) for i in rows.column("item_id").to_pylist()], rows.column("text").to_pylist(), n)
        items.null = pc.is_null(rows.column("item_id")).to_numpy()
        if len(items.table):
            items.choose(counts(docs.select(F.col("text").cast("string").alias("text")), items), rare, min_seeds)
            yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.4, rare: int = 1000, min_seeds: int = 12, slice_bytes: int = 8 << 20) -> DataFrame:
    """A row for each document and item that align with a score of threshold or more: doc_id, item_id, score, first_word (of the stretch), seeds.

    rare is a number of documents, whatever the size of the table.

    An item or a document of fewer than n words is one n-gram of all its
    words. Null and empty texts match nothing. Very long texts are searched
    whole. Null doc_id or item_id: the
    row has null there. Repeated documents give a row each; repeated items
    too. Tied scores: the stretch that begins first. An empty table on either
    side gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for items in sliced(docs, benchmark, n, rare, min_seeds, slice_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            items = shared.value
            for b in kit.slices(batches):
                doc, item, score, first, seeds = found_in(b.column("text"), items, threshold)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(items.ids[item], mask=items.null[item]), pa.array(score), pa.array(first.astype(np.int64)), pa.array(seeds.astype(np.int32))], ["doc_id", "item_id", "score", "first_word", "seeds"])

        found.append(slim.mapInArrow(kit.batchwise(run), SCHEMA))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.4, rare: int = 1000, min_seeds: int = 12, slice_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that align with no item.

    Rows with null or empty text or null doc_id stay or go by their text alone,
    null and empty ones stay; so do all where the benchmark is empty. Very long
    texts are searched whole. Repeated rows stay or go together. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    out = docs
    for items in sliced(docs, benchmark, n, rare, min_seeds, slice_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            items = shared.value
            for b in kit.slices(batches):
                keep = np.ones(b.num_rows, bool)
                keep[found_in(pc.cast(b.column("text"), pa.string()), items, threshold)[0]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(kit.batchwise(run), docs.schema)
    return out
