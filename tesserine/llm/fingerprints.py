"""Improbable-feature digests of documents, and their comparison.

A feature is a window of 64 bytes of UTF-8. Its entropy, in thousandths of
the largest, is looked up in a rank of rarity: the fewer windows of the whole
corpus have that entropy, the lower the rank. In each run of 64 windows the
first of lowest rank gets a point; windows with 16 points or more are the
document's features. Windows of very low entropy get none.

Features enter Bloom filters of 2048 bits by five hashes, 160 to a filter, a
full one followed by another: the digest. What a filter has in common with
another is the overlap of their bits above what chance gives, over the most
that it could be, 0 up to CHANCE of that. The similarity of two digests is
the mean, over the features of the one with more of them, of what their
filters have in common with the other's best matching filter: the share of
the larger document that the smaller one covers, from 0 to 1.

A digest similarity of t needs about t times the larger one's features in
common, hence a Jaccard similarity of the features of t / (2 - t) or more.
Digests are compared wherever documents hang together by a Jaccard similarity
of 0.4 t, which leaves room for what chance adds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit
from .components import components
from .setjoin import candidates, classes, shared_sets, twins, verified

WINDOW, RUN, POINTS = 64, 64, 16
BITS, HASHES, FULL, CHANCE = 2048, 5, 160, 0.3
STEPS, WEAK = 1000, 100
U64 = kit.U64
#: c * log2(c) in units of 2**-24, whole numbers so that sums don't depend on their order
WEIGHT = np.round(np.r_[0, np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))] * (1 << 24)).astype(np.int64)


def entropies(data: np.ndarray) -> np.ndarray:
    """Of each window of 64 bytes, its entropy from 0 to STEPS."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int16)
    order = np.argsort(data, kind="stable")
    key = (data[order].astype(np.int64) << 40) | order
    place = np.arange(n)
    forward, back = np.empty(n, np.int64), np.empty(n, np.int64)
    forward[order] = np.searchsorted(key, key + WINDOW) - place  # as many of this byte in the window that begins here
    back[order] = place - np.searchsorted(key, key - WINDOW + 1) + 1  # ... that ends here
    out, into = np.diff(WEIGHT)[forward[: n - WINDOW] - 1], np.diff(WEIGHT)[back[WINDOW:] - 1]
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = WEIGHT[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(into - out, out=total[1:])
    total[1:] += total[0]
    top = 6 * WINDOW << 24
    return ((top - total) * STEPS // top).astype(np.int16)


def inside(off: np.ndarray, n: int, length: int) -> np.ndarray:
    """Whether each stretch of length that begins at one of n places lies in one text."""
    ok = np.ones(n, bool)
    for end in off[1:-1]:
        ok[max(0, end - length + 1) : end] = False
    return ok


def features(texts: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each feature, in the order of the texts, every one once a text. rank is by entropy; negative: none."""
    data, off = kit.string_bytes(texts)
    e = entropies(data)
    if len(e) < RUN:
        return np.empty(0, U64), np.empty(0, np.int64)
    value = (rank[e].astype(np.int64) << 32) | np.arange(len(e))
    value[(rank[e] < 0) | ~inside(off, len(e), WINDOW)] = np.iinfo(np.int64).max
    width = 1
    while width < RUN:
        value = np.minimum(value[: len(value) - width], value[width:])
        width *= 2
    value = value[inside(off, len(value), RUN + WINDOW - 1)]
    value = value[value != np.iinfo(np.int64).max]
    at = np.flatnonzero(np.bincount(value & 0xFFFFFFFF, minlength=1) >= POINTS)
    up, down = kit.powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    h = kit.mix((total[at + WINDOW] - total[at]) * down[at] * kit.SALTS[50])
    doc = np.searchsorted(off, at, "right") - 1
    order = np.lexsort((at, h, doc))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    keep = np.sort(order[~again])
    return h[keep], doc[keep]


def digest(h: np.ndarray) -> np.ndarray:
    """The filters of one document's features, a row of bytes each."""
    rows = kit.parts(len(h), FULL) if len(h) else 0
    bits = np.zeros((rows, BITS), bool)
    row = np.arange(len(h)) // FULL
    for k in range(HASHES):
        bits[row, ((h >> U64(11 * k)) & U64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def digest_scores(left: list[bytes], n_left: np.ndarray, right: list[bytes] | None, n_right: np.ndarray | None) -> np.ndarray:
    """Similarity of every digest of left with every one of right, or of left; n_left and n_right are their numbers of features."""

    def unpack(digests: list[bytes], n: np.ndarray):
        rows = np.array([len(d) // (BITS // 8) for d in digests], np.int64)
        of = np.repeat(np.arange(len(digests)), rows)
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32)
        return bits, of, np.minimum(FULL, n[of] - kit.ranges(rows) * FULL)

    a, of_a, n_a = unpack(left, n_left)
    b, of_b, n_b = (a, of_a, n_a) if right is None else unpack(right, n_right)
    n_right = n_left if right is None else n_right
    out = np.zeros((len(n_left), len(n_right)))
    if not len(of_a) or not len(of_b):
        return out
    ones_a, ones_b = a.sum(1), b.sum(1)
    stay = lambda n: (1 - 1 / BITS) ** (HASHES * n)
    first_a, first_b = (np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) for of in (of_a, of_b))
    by_a, by_b = np.empty((len(a), len(first_b)), np.float32), np.zeros((len(first_a), len(b)), np.float32)
    ends = np.r_[first_a[1:], len(a)]
    x = 0
    while x < len(a):  # whole digests of left, about 512 filters of theirs at once
        k = int(np.searchsorted(first_a, x))
        last = max(k, int(np.searchsorted(ends, x + 512, "right")) - 1)
        y = int(ends[last])
        over = a[x:y] @ b.T
        chance = BITS * (1 - stay(n_a[x:y, None]) - stay(n_b[None, :]) + stay(n_a[x:y, None] + n_b[None, :]))

        def share(ones: np.ndarray, over: np.ndarray = over, chance: np.ndarray = chance) -> np.ndarray:
            least = chance + CHANCE * np.maximum(ones - chance, 0)
            return np.clip((over - least) / np.maximum(ones - least, 1e-6), 0, 1)

        by_a[x:y] = np.maximum.reduceat(share(ones_a[x:y, None]), first_b, axis=1)
        by_b[k : last + 1] = np.maximum.reduceat(share(ones_b[None, :]), first_a[k : last + 1] - x, axis=0)
        x = y
    some_a, some_b = of_a[first_a], of_b[first_b]
    na, nb = n_left[some_a][:, None], n_right[some_b][None, :]
    a_in_b, b_in_a = np.add.reduceat(by_a * n_a[:, None], first_a, axis=0) / na, np.add.reduceat(by_b * n_b[None, :], first_b, axis=1) / nb
    out[np.ix_(some_a, some_b)] = np.where(na > nb, a_in_b, np.where(na < nb, b_in_a, np.minimum(a_in_b, b_in_a)))
    return out


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy by how few windows of all docs have it; -1 below WEAK."""

    def count(batches):
        total = np.zeros(STEPS + 1, np.int64)
        for b in kit.slices(batches):
            data, off = kit.string_bytes(b.column("text"))
            e = entropies(data)
            total += np.bincount(e[inside(off, len(e), WINDOW)], minlength=STEPS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS + 1)), pa.array(total)], ["e", "n"])

    n = np.zeros(STEPS + 1, np.int64)
    for row in docs.mapInArrow(kit.batchwise(count), "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).collect():  # STEPS + 1 rows
        n[row.e] = row.n
    rank = np.empty(STEPS + 1, np.int32)
    rank[np.lexsort((np.arange(STEPS + 1), n))] = np.arange(STEPS + 1)
    rank[:WEAK] = -1
    return rank


def digested(docs: DataFrame, threshold: float) -> tuple[DataFrame, tuple]:
    """doc_id, n_features, features and digest of all docs; what setjoin.verified and classes take."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(rarity(slim.select("text")))

    def find(batches):
        for b in kit.slices(batches):
            h, doc = features(b.column("text"), rank.value)
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            own = [h[at[k] : at[k + 1]] for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), kit.binary(own), kit.binary([digest(x) for x in own])], ["doc_id", "n_features", "features", "digest"])

    def tokens(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own = b.column("features").to_pylist()
        return kit.distinct_by_doc(np.frombuffer(b"".join(own), U64), np.repeat(np.arange(len(own)), [len(x) // 8 for x in own]))

    found = kit.cut(slim.mapInArrow(kit.batchwise(find), "doc_id long, n_features long, features binary, digest binary"))
    total = found.agg(F.sum("n_features")).first()[0] or 0
    sets = shared_sets(found.select("doc_id", "features"), "features", tokens, total, 0.4 * threshold)
    roots = components(candidates(sets, 0.4 * threshold))

    def similarity(left: pa.Table, right: pa.Table | None) -> np.ndarray:
        read = lambda t: (t.column("digest").to_pylist(), t.column("n_features").to_numpy())
        return digest_scores(*read(left), *((None, None) if right is None else read(right)))

    digests = found.filter("doc_id is not null and n_features > 0").select("doc_id", "n_features", "digest")
    return found, (digests, "digest", roots, twins(digests, "digest"), similarity, threshold)


def fingerprints(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_features, n_filters, digest, and similar: the doc_ids, ascending, whose digests have a similarity of threshold or more.

    Null texts and texts with no feature, such as those under 127 bytes: 0
    features, 0 filters, an empty digest, similar to nothing. Very long texts have as many filters as their
    features need. A similarity equal to the threshold counts. Null doc_id:
    digested, but in no list, and with an empty one. Repeated rows have the
    same digest; no doc_id is in its own list, and the rows of one doc_id have
    the same list. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    found, searched = digested(docs, threshold)
    pairs = verified(*searched)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lists = both.groupBy(F.col("a").alias("_id")).agg(F.array_sort(F.collect_set("b")).alias("similar"))
    out = found.join(lists, F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", "n_features", F.ceil(F.col("n_features") / FULL).alias("n_filters"), "digest", F.coalesce("similar", F.array().cast("array<long>")).alias("similar"))


def fingerprint_classes(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_features, n_filters, digest, class_id and links of every row: the smallest doc_id among the documents that hang together by digests with a similarity of threshold or more, and how many documents have such a digest.

    As fingerprints, without the lists, whose lengths add up to the square of
    a group of copies. A document similar to nothing is a class of its own,
    with 0 links; null doc_id: null class_id, 0 links.
    """
    found, searched = digested(docs, threshold)
    out = found.join(classes(*searched), F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_features", F.ceil(F.col("n_features") / FULL).alias("n_filters"), "digest", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
